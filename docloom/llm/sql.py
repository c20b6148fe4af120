"""SQL for DuckDB of the operators that it can express whole."""

from __future__ import annotations

# CRC-32 byte by byte: the register moves right, its low byte picks the entry to add.
_TABLE = """list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"""
_WORDS = """regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""


def _features(relation: str) -> str:
    return f"""
      select row, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                         || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as f
      from (select row, {_WORDS} as w from {relation})"""


RESAMPLING = f"""
  with docs as materialized (select *, row_number() over () as row from documents),
  goals as (select text, row_number() over () as row from benchmark),
  df as materialized ({_features('docs')}),
  bf as materialized ({_features('goals')}),
  tab as (select {_TABLE} as t),
  crcs as materialized (
    select f, xor(list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as bucket
    from (select f, list_transform(range(0, strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::bigint) as b
          from (select f from df union select f from bf)), tab),
  s as (select bucket, count(*) as s from df join crcs using (f) group by 1),
  t as (select bucket, count(*) as t from bf join crcs using (f) group by 1),
  gains as materialized (
    select bucket, cast(floor(1000 * ln(((coalesce(t, 0) + 1.0::double) * ((select count(*) from df) + 10000))
             / ((coalesce(s, 0) + 1.0::double) * ((select count(*) from bf) + 10000)))) as bigint) as gain
    from s full join t using (bucket)),
  weights as (
    select row, count(*) as n_features, cast(sum(gain) as bigint) as weight
    from df join crcs using (f) join gains using (bucket) group by 1),
  scored as (
    select doc_id, row, len({_WORDS}) >= 20 as long, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
           coalesce(weight, 0) + cast(floor(-1000 * ln(-ln(
             (('0x' || substr(sha256('42:' || coalesce(cast(doc_id as varchar), '')), 1, 8))::bigint + 0.5::double) / 4294967296.0::double))) as bigint) as score
    from docs left join weights using (row)),
  placed as (
    select *, row_number() over (partition by long order by score desc, doc_id) as n, count(*) over (partition by long) as total
    from scored)
  select doc_id, n_features, weight, score, case when long and n <= total * 5 // 100 then n end as rank
  from placed"""


def _distance(a: str, b: str) -> str:
    return f"cast(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint)"


def _assigned(n: int) -> str:
    return f"""
      a{n} as materialized (
        select row, any_value(vec_id) as vec_id, any_value(v) as v, min({{'d': {_distance('v', 'c')}, 'j': j}}) as best
        from vectors, c{n} group by row)"""


def _moved(n: int) -> str:
    return f"""
      c{n + 1} as materialized (
        select j, coalesce(m, c) as c from c{n} left join (
          select j, list(x order by i) as m from (
            select best.j as j, i, cast(floor(sum(v[i]) / count(*)) as bigint) as x
            from a{n}, (select unnest(range(1, 65)) as i) group by 1, 2)
          group by 1) using (j))"""


CENTROIDS = f"""
  with vectors as materialized (
    select vec_id, row_number() over () as row, list_transform(embedding, lambda x: cast(floor(x::double * 64) as bigint)) as v
    from embeddings
    where len(embedding) = 64 and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
  c0 as materialized (
    select row_number() over (order by h, v) - 1 as j, v as c
    from (select v, sha256('1:' || coalesce(cast(vec_id as varchar), '')) as h from vectors order by h, v limit 16)),
  {_assigned(0)}, {_moved(0)}, {_assigned(1)}, {_moved(1)}, {_assigned(2)}, {_moved(2)}, {_assigned(3)}
  select vec_id, cast(j as integer) as cluster, best.d as distance,
         cast(sum(best.d) over (partition by j) as bigint) as cluster_inertia,
         cast(sum(best.d) over () as bigint) as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
  from a3 join c3 on c3.j = best.j"""
