"""SQL for DuckDB that gives the same rows as each registered query.

Written from the query semantics in terms of lists, recursive CTEs and windows. Regular
expressions are in RE2 syntax, whose word boundaries are ASCII.
"""

from __future__ import annotations

from workload.queries import CUSTOMER_NOTE

NL = "chr(10)"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
DOCS = (
    "(select doc_id, cast(doc_id as varchar) as document_id, text, lang, source, "
    f"replace(text, {NL}, {NL} || {NL}) as content from documents)"
)
CREATED = "(timestamp '2024-01-01 00:00:00' + to_minutes(doc_id))"


def stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def words(expr: str) -> str:
    return rf"cast(len(regexp_extract_all({expr}, '\S+')) as bigint)"


FILENAME = (
    "(source || '/d' || cast(doc_id as varchar) || case lang when 'en' then '.MD' "
    "when 'fr' then '.tar.HTM' when 'de' then '' else '.webp' end)"
)
FILE_TYPE = "(case lang when 'en' then 'md' when 'fr' then 'html' when 'de' then 'txt' else 'image' end)"

# What counts as personal data, as (category, lead, value, tail) in RE2 syntax.
SET_TO = r"""\s*[:=]\s*[''"]?"""
SECRET = r"""[^\s''"]+"""
KEY = "[a-zA-Z0-9_-]{20,}"
QUOTE = """[''"]?"""
RULES = [
    ("password", "password" + SET_TO, SECRET, QUOTE),
    ("password", "pwd" + SET_TO, SECRET, QUOTE),
    ("password", "pass" + SET_TO, SECRET, QUOTE),
    ("api_key", "api[_-]?key" + SET_TO, KEY, QUOTE),
    ("api_key", "secret[_-]?key" + SET_TO, KEY, QUOTE),
    ("api_key", "access[_-]?token" + SET_TO, KEY, QUOTE),
    ("api_key", "", "sk-[a-zA-Z0-9]{32,}", ""),
    ("api_key", "", "pk-[a-zA-Z0-9]{32,}", ""),
    ("api_key", "", "AIza[a-zA-Z0-9_-]{35}", ""),
    (
        "credit_card",
        "",
        r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b",
        "",
    ),
    ("ssn", "", r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", ""),
    ("email", "", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", ""),
    ("phone", "", r"\b(?:\+?1[-.\s]?)?\(?[2-9]\d{2}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", ""),
    ("phone", "", r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b", ""),
    (
        "address",
        "",
        r"\b\d{1,5}\s+[\pL\pN_]+(?:\s+[\pL\pN_]+)*\s+"
        "(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct)",
        r"(?:[^\pL\pN_]|$)",
    ),
]


def rule_spans(relation: str, key: str, text: str, rank: int) -> str:
    """Matches of one rule with offsets from a running sum over split pieces."""
    category, lead, value, tail = RULES[rank]
    whole, head = f"(?i){lead}{value}{tail}", f"(?i)^{lead}"
    found, at = "h", "o + len(g)"
    if lead or tail:
        found = f"regexp_extract(h, '{head}({value}){tail}', 1)"
    if lead:
        at = f"o + len(g) + len(regexp_extract(h, '{head}', 0))"
    return f"""
      select {key}, '{category}' as category, {rank} as rank, {found} as text,
             cast({at} as integer) as start, cast({at} + len({found}) as integer) as "end"
      from (
        select {key}, h, g,
               coalesce(sum(len(h) + len(g)) over (
                 partition by {key} order by i rows between unbounded preceding and 1 preceding), 0) as o
        from (
          select {key}, unnest(range(1, len(hs) + 1)) as i, unnest(hs) as h, unnest(gs[1:len(hs)]) as g
          from (
            select {key}, regexp_extract_all({text}, '{whole}') as hs,
                   regexp_split_to_array({text}, '{whole}') as gs
            from {relation} where regexp_matches({text}, '{whole}')
          )
        )
      )"""


def all_spans(relation: str, key: str, text: str = "text", categories=None) -> str:
    """Every hit of every rule, before positions are made unique."""
    chosen = [i for i, r in enumerate(RULES) if categories is None or r[0] in categories]
    return " union all ".join(rule_spans(relation, key, text, i) for i in chosen)


def spans(relation: str, key: str, text: str = "text", categories=None) -> str:
    return f"""
      select * exclude (n) from (
        select *, row_number() over (partition by {key}, start, "end" order by rank) as n
        from ({all_spans(relation, key, text, categories)})
      ) where n = 1"""


def found_categories(relation: str, key: str, text: str = "text", categories=None) -> str:
    return f"""
      select {key}, string_agg(category, ',' order by category) as categories_found
      from (select distinct {key}, category from ({all_spans(relation, key, text, categories)}))
      group by {key}"""


def redacted(relation: str, key: str, text: str = "text", categories=None) -> str:
    """``key, redacted``: overlapping spans merged, one tag per merged span."""
    by_start = f'partition by {key} order by start, "end" desc'
    return f"""
      with reached as (
        select *, max("end") over ({by_start} rows between unbounded preceding and 1 preceding) as reach
        from ({spans(relation, key, text, categories)})),
      grouped as (
        select *, sum(case when reach is null or start >= reach then 1 else 0 end)
                    over ({by_start} rows unbounded preceding) as g
        from reached),
      merged as (
        select {key}, g, min(start) as start, max("end") as "end",
               arg_min(category, {{'s': start, 'e': -"end"}}) as category
        from grouped group by {key}, g),
      opened as (
        select *, coalesce(lag("end") over (partition by {key} order by start), 0) as open,
               row_number() over (partition by {key} order by start desc) as back
        from merged),
      pieces as (
        select {key}, string_agg(
                 substr(r.{text}, open + 1, start - open) || '[REDACTED_' || upper(category) || ']'
                 || case when back = 1 then substr(r.{text}, "end" + 1) else '' end, '' order by start) as done
        from opened join {relation} r using ({key}) group by {key})
      select {key}, coalesce(done, r.{text}) as redacted from {relation} r left join pieces using ({key})"""


def chunk_sql(relation: str, size: int = 1000, overlap: int = 200) -> str:
    """Paragraph packing as a recursive fold; ``relation`` has document_id and content."""
    gap = f"{NL} || {NL}"
    return f"""
      with recursive paras as (
        select document_id, list_filter(
                 list_transform(string_split(trim(content, {SPACES}), {gap}), lambda x: trim(x, {SPACES})),
                 lambda x: x <> '') as ps
        from {relation} where content is not null
      ),
      fold as (
        select document_id, ps, 0 as i, '' as cur, cast(null as varchar) as emitted from paras
        union all
        select document_id, ps, i + 1,
               case when i = len(ps) then ''
                    when flush then (case when carry <> '' then carry || {gap} else '' end) || p || {gap}
                    else cur || p || {gap} end,
               case when i = len(ps) then nullif(trim(cur, {SPACES}), '')
                    when flush then trim(cur, {SPACES}) end
        from (
          select *, ps[i + 1] as p, trim(right(cur, {overlap}), {SPACES}) as carry,
                 cur <> '' and len(cur) + len(ps[i + 1]) + 2 > {size} as flush
          from fold where i <= len(ps)
        )
      ),
      made as (
        select document_id, emitted as content,
               row_number() over (partition by document_id order by i) - 1 as chunk_index
        from fold where emitted is not null
      )
      select document_id, document_id || '_chunk_' || cast(chunk_index as varchar) as chunk_id,
             chunk_index, content, cast(len(content) as bigint) as char_count,
             {words('content')} as word_count
      from made"""


def bucket_sql(relation: str, key: str, text: str, dim: int) -> str:
    """Non-zero entries of the hashed embedding: key, bucket, unit-length FLOAT value."""
    digit = "(('0x' || substr(md5(token), 5, 1))::int)"
    return f"""
      select {key}, bucket, (s / sqrt(sum(s * s) over (partition by {key})))::float::double as value
      from (
        select {key}, (('0x' || substr(md5(token), 1, 4))::int) % {dim} as bucket,
               sum(case when {digit} % 2 = 0 then 1 else -1 end)::double as s
        from (select {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) as token from {relation})
        group by 1, 2
      ) where s <> 0"""


ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&nbsp;", " "),
    ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&hellip;", "…"), ("&ndash;", "–"),
    ("&mdash;", "—"), ("&amp;", "&"),
)
BLOCKS = (
    "address|article|aside|blockquote|body|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|"
    "header|hr|html|li|main|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
)


def unescaped(expr: str) -> str:
    for name, char in ENTITIES:
        expr = f"replace({expr}, '{name}', '{char}')"
    return expr


def html_sql(expr: str) -> str:
    def swap(e: str, pattern: str, by: str) -> str:
        return f"regexp_replace({e}, '{pattern}', {by}, 'g')"

    out = swap(expr, r"(?s)<!--(?:.*?-->|.*\z)", "''")
    for tag in ("script", "style", "nav", "head", "template", "noscript"):
        end = rf".*?</{tag}\s*>"
        end = end if tag in ("nav", "head") else rf"(?:{end}|.*\z)"
        out = swap(out, rf"(?is)<{tag}(?:\s[^>]*)?>{end}", "''")
    out = swap(out, r"\s+", "' '")
    for level in range(1, 7):
        out = swap(out, rf"(?i)<h{level}(?:\s[^>]*)?>", f"{NL} || {NL} || '{'#' * level} '")
    out = swap(out, r"(?i)</h[1-6]\s*>", f"{NL} || {NL}")
    out = swap(out, r"(?i)<br\s*/?>", NL)
    out = swap(out, rf"(?i)</?(?:{BLOCKS})(?:\s[^>]*)?/?>", f"{NL} || {NL}")
    out = swap(out, "<[a-zA-Z/!?][^>]*>", "''")
    out = unescaped(out)
    out = swap(out, r" *\n *", NL)
    out = swap(out, r"\n{3,}", f"{NL} || {NL}")
    return f"trim({out}, ' ' || {NL})"


MEANS = """
  select label::bigint as query_id, pos, round(avg(x::double), 6) as x
  from (select label, unnest(range(1, len(embedding) + 1)) as pos, unnest(embedding) as x from embeddings)
  group by label, pos"""
MEAN_VECTORS = f"select query_id, list(x order by pos) as qv from ({MEANS}) group by query_id"
VECTORS = """
  (select case when label < 5 then 'low' else 'high' end as namespace, cast(vec_id as varchar) as id,
          'd' || cast(label as varchar) as document_id, embedding as vals, label from embeddings)"""


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::double[], {b}::double[])"


def topk_sql(scored: str, k: str = "5") -> str:
    """``scored`` gives query_id, id, raw; ranks by rounded score, then id."""
    return f"""
      select query_id, id, round(score, 6) as score, rank from (
        select query_id, id, score,
               row_number() over (partition by query_id order by score desc, id) as rank
        from (select query_id, id, round(raw, 9) as score from ({scored}))
      ) where rank <= {k}"""


def cell(v: str, bits: int = 4) -> str:
    parts = [
        f"(case when list_sum(list_transform({v}, lambda x, j: case when bit_count((j - 1)::bigint "
        f"& {i + 1}) % 2 = 0 then x::double else -(x::double) end)) > 0 then {1 << i} else 0 end)"
        for i in range(bits)
    ]
    return "(" + " + ".join(parts) + ")"


APPROXIMATE = f"""
  select q.query_id, cast(e.vec_id as varchar) as id, {cosine('q.qv', 'e.embedding')} as raw
  from (select *, {cell('qv')} as c from ({MEAN_VECTORS})) q
  join (select *, {cell('embedding')} as c from embeddings) e on bit_count(xor(q.c, e.c)::bigint) <= 1"""
EXACT = f"""
  select q.query_id, cast(e.vec_id as varchar) as id, {cosine('q.qv', 'e.embedding')} as raw
  from ({MEAN_VECTORS}) q, embeddings e"""

CHUNKS = chunk_sql(DOCS)
SEARCH_SCORES = f"""
  chunked as materialized ({CHUNKS}),
  cv as materialized ({bucket_sql('chunked', 'chunk_id', 'content', 384)}),
  qv as materialized ({bucket_sql('benchmark', 'item_id', 'text', 384)}),
  cn as (select chunk_id, sqrt(sum(value * value)) as n from cv group by 1),
  qn as (select item_id, sqrt(sum(value * value)) as n from qv group by 1),
  scores as materialized (
    select item_id as query_id, chunk_id, round(d / (qn.n * cn.n), 9) as score
    from (select item_id, chunk_id, sum(qv.value * cv.value) as d from qv join cv using (bucket) group by 1, 2)
    join cn using (chunk_id) join qn using (item_id)
  )"""


def search_sql(final: str, threshold: float = 0.3, k: int = 5) -> str:
    return f"""
      with {SEARCH_SCORES},
      hits as (
        select s.*, c.document_id, c.content from (
          select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank
          from scores where score >= {threshold}
        ) s join chunked c using (chunk_id) where rank <= {k}
      )
      {final}"""


RECORD = "select namespace, id, document_id, round(vals[1]::double, 6) as first_value, cast(label as bigint) as label"
LISTING = f"(select cast(doc_id as varchar) as document_id, source, {CREATED} as created_at from documents)"
REQUEST = (
    "(select cast(doc_id as varchar) as document_id from labels where toxic = 1 "
    "union select 'x' || cast(doc_id as varchar) from labels where toxic = 1)"
)
UPLOADS = f"""
  (select doc_id, document_id, content, text, lang,
          'd' || document_id || case lang when 'en' then '.md' when 'es' then '.pdf' else '.txt' end as filename,
          case lang when 'en' then 'md' when 'es' then 'pdf' else 'txt' end as file_type,
          case when lang = 'es' then 'unsupported format: pdf'
               when lang = 'fr' and regexp_matches(text, '[^\\x00-\\x7F]') then 'not valid UTF-8' end as error_message
   from {DOCS})"""
# The identifier hashes the stored bytes; for Latin-1 files those are rebuilt from code points.
LATIN = "from_hex(list_aggregate(list_transform(string_split(content, ''), lambda ch: printf('%02x', ord(ch))), 'string_agg', ''))"
UPLOAD_ID = (
    f"substr(sha256(case when lang = 'fr' then {LATIN} || encode(filename) "
    "else encode(content || filename) end), 1, 16)"
)
STATUS = """
  (select user_id as id, case event_type when 'signup' then 'pending' when 'view' then 'processing'
          when 'click' then 'processing' when 'purchase' then 'completed' else 'failed' end as status,
          props as error, cast(floor(value) as bigint) as progress, ts, event_id as seq from events)"""
STATES = f"""
  (select id, s.status as status, case when s.status = 'failed' then s.error end as error, s.progress as progress,
          created_at, started_at,
          case when s.status in ('completed', 'failed') then s.ts end as completed_at
   from (select id, arg_max({{'status': status, 'error': error, 'progress': progress, 'ts': ts}},
                            {{'ts': ts, 'seq': seq}}) as s,
                min(ts) as created_at, min(ts) filter (status = 'processing') as started_at
         from {STATUS} group by id))"""
NOTES = f"(select c_custkey, {CUSTOMER_NOTE} as text from customer)"
STREAM_DOCS = f"""
  (select substr(sha256(content || 'd' || document_id || '.txt'), 1, 16) as document_id,
          'd' || document_id || '.txt' as filename, content
   from {DOCS})"""
EXTRACTED = """
  (select document_id, lower(x.c) as class, x.t as text from (
     select cast(doc_id as varchar) as document_id, unnest(
       list_transform(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9.]+[a-z]'), lambda t: {'c': 'email', 't': t})
       || list_transform(regexp_extract_all(text, '[0-9]{16}'), lambda t: {'c': 'credit_card', 't': t})
       || list_transform(regexp_extract_all(text, '[0-9a-f]{40}'), lambda t: {'c': 'api_key', 't': t})) as x
     from documents))"""
# Strings of the stand-in extractor that lie in their document, with both of their labels.
LABELLED = f"""
  (select distinct document_id, e.text, cast(instr(d.text, e.text) - 1 as integer) as start, unnest([class, 'address']) as category
   from {EXTRACTED} e join {DOCS} d using (document_id) where instr(d.text, e.text) > 0
   union
   select cast(doc_id as varchar), c, 0, 'address'
   from (select doc_id, text, regexp_extract(text, '^[A-Z][a-z]+') as c from documents) where c <> '')"""
STORED = f"""
  u as materialized (select *, {UPLOAD_ID} as upload_id from {UPLOADS}),
  readable as materialized (select upload_id as document_id, content as original from u where error_message is null),
  good as materialized (select document_id, original, redacted as content
                        from ({redacted('readable', 'document_id', 'original')}) join readable using (document_id)),
  made as (select document_id, count(*) as n from ({chunk_sql('good')}) group by 1),
  found as ({found_categories('good', 'document_id', 'original')})"""
CATEGORY_RANK = "list_position(['password','api_key','credit_card','ssn','email','phone','address'], category)"

ORACLE = {
    "document_ids": f"""
      select doc_id, {FILE_TYPE} as file_type, substr(sha256(text || {FILENAME}), 1, 16) as document_id,
             {words('text')} as word_count, cast(len(text) as bigint) as char_count, md5(text) as text_key
      from documents""",
    "upload_admission": f"""
      select doc_id, {FILE_TYPE} as file_type,
             case when lang <> 'en' then 'file type not allowed'
                  when strlen(text) > 4000 then 'file too large' end as reject_reason
      from documents""",
    "extract_status": f"""
      select {UPLOAD_ID} as document_id, filename, file_type,
             case when error_message is null then 'completed' else 'failed' end as status, error_message,
             case when error_message is null then {words('content')} end as word_count,
             case when file_type = 'md' and error_message is null
                  then nullif(regexp_extract(content, '(?m)^#{{1,6}}[ \\t]+(.+?)[ \\t]*$', 1), '') end as title
      from {UPLOADS}""",
    "html_text": f"""
      select filename, content, title, has_tables, has_images, {words('content')} as word_count,
             'completed' as status
      from (select cast(page_id as varchar) || '.html' as filename, {html_sql('html')} as content,
                   nullif({unescaped(r"regexp_extract(html, '(?is)<title(?:\s[^>]*)?>\s*(.*?)\s*</title\s*>', 1)")}, '') as title,
                   regexp_matches(html, '(?i)<table[\\s>/]') as has_tables,
                   regexp_matches(html, '(?i)<img[\\s>/]') as has_images
            from pages)""",
    "scanned_files": r"""
      with f as (
        select source, lang, cast(sum(strlen(text) + 1) as bigint) as bytes,
               sum(len(regexp_extract_all(text, '\S+'))) as n
        from documents group by 1, 2)
      select source, lang, bytes, case when bytes > 200000 then 'file too large' end as reason,
             cast((select sum(n) from f where bytes <= 200000) as bigint) as words_read
      from f""",
    "media_counts": """
      select cast(doc_id as varchar) || case lang when 'en' then '.md' else '.txt' end as filename,
             case lang when 'en' then nullif(doc_id % 2, 0) end as table_count,
             case lang when 'en' then nullif(doc_id % 3, 0) end as image_count
      from documents""",
    "pii_spans": f"""
      select doc_id, category, text, start, "end", 0.8::double as confidence, 'regex' as source
      from ({spans('documents', 'doc_id')})""",
    "customer_pii": f"""
      select c_custkey, category, text, start, "end" from ({spans(NOTES, 'c_custkey')})""",
    "customer_redacted": f"""
      with n as materialized {NOTES}
      select c_custkey, redacted, categories_found
      from ({redacted('n', 'c_custkey')}) join ({found_categories('n', 'c_custkey')}) using (c_custkey)""",
    "pii_summary": f"""
      select doc_id, categories_found is not null as has_pii, coalesce(categories_found, '') as categories_found
      from documents left join ({found_categories('documents', 'doc_id')}) using (doc_id)""",
    "pii_redacted": redacted("documents", "doc_id"),
    "pii_request": f"""
      with c as materialized (select *, conv_id || '/' || turn as k from conversations where len(text) >= 1)
      select conv_id, turn, redacted <> text as has_pii, redacted
      from ({redacted('c', 'k', 'text', ('password', 'api_key', 'credit_card'))}) join c using (k)""",
    "pii_extractions": f"""
      with model as (
        select document_id, start, start + cast(len(text) as integer) as "end", text,
               arg_min(class, {CATEGORY_RANK.replace('category', 'class')}) as category
        from (select distinct document_id, class, e.text, cast(instr(d.text, e.text) - 1 as integer) as start
              from {EXTRACTED} e join {DOCS} d using (document_id))
        where start >= 0 group by all
      )
      select document_id, category, text, start, "end", 0.9::double as confidence, 'langextract' as source from model
      union all
      select cast(doc_id as varchar), category, text, start, "end", 0.8::double, 'regex'
      from ({spans('documents', 'doc_id')}) s
      where not exists (select 1 from model m where m.document_id = cast(s.doc_id as varchar)
                        and m.start = s.start and m."end" = s."end")""",
    "pii_categories": f"""
      with hits as (
        select cast(doc_id as varchar) as document_id, category, start, "end" from ({all_spans('documents', 'doc_id')})
        union all
        select document_id, category, start, start + cast(len(text) as integer) from {LABELLED})
      select document_id, coalesce(string_agg(distinct category, ',' order by category), '') as categories_found,
             count(distinct {{'s': start, 'e': "end"}}) filter (start is not null) as detections
      from (select document_id from {DOCS}) left join hits using (document_id) group by 1""",
    "pii_switched_off": """
      select doc_id, false as has_pii, 0::bigint as categories, 0::bigint as detections, true as unchanged
      from documents""",
    "pii_flags": f"""
      select cast(doc_id as varchar) as document_id, categories_found is not null as has_pii,
             coalesce(categories_found, '') as pii_categories_found
      from documents left join ({found_categories('documents', 'doc_id')}) using (doc_id)""",
    "chunks": CHUNKS,
    "chunk_counts": f"select document_id, count(*) as chunk_count from ({CHUNKS}) group by 1",
    "section_nodes": f"""
      with recursive paras as (
        select document_id, list_filter(
                 list_transform(string_split(content, {NL} || {NL}), lambda x: trim(x, {SPACES})),
                 lambda x: x <> '') as ps
        from {DOCS}
      ),
      fold as (
        select document_id, ps, 1 as i, 0 as node, {words('ps[1]')} as tokens from paras where len(ps) > 0
        union all
        select document_id, ps, i + 1, case when t + tokens > 150 or heading then node + 1 else node end,
               case when t + tokens > 150 or heading then t else t + tokens end
        from (select *, {words('ps[i + 1]')} as t, regexp_matches(ps[i + 1], '^#{{1,6}}[ \\t]+\\S') as heading
              from fold where i < len(ps))
      )
      select document_id, cast(node as bigint) as node_index, max(tokens) as token_count,
             string_agg(ps[i], {NL} || {NL} order by i) as content
      from fold group by document_id, node""",
    "embedded": f"""
      select doc_id, cast(bucket as bigint) as bucket, round(value, 6) as value
      from ({bucket_sql('documents', 'doc_id', 'text', 384)})""",
    "cache_split": """
      select md5(text) as text_key, count(*) as copies,
             md5(text) in (select md5(text) from documents join labels using (doc_id) where quality = 1) as cached
      from documents group by 1""",
    "cache_embed": f"""
      with good as (select md5(text) as text_key from documents join labels using (doc_id) where quality = 1)
      select doc_id, cast(case when md5(text) in (select text_key from good) then 1 else 2 end as bigint) as inserted_seq,
             round(coalesce(m, 0), 4) as magnitude
      from documents left join (
        select doc_id, sum(abs(value)) as m from ({bucket_sql('documents', 'doc_id', 'text', 384)}) group by 1
      ) using (doc_id)""",
    "cache_evict": """
      with c as (select md5(text) as text_key, min(doc_id) as inserted_seq from documents group by 1)
      select text_key, inserted_seq from (
        select *, row_number() over (order by inserted_seq, text_key) as n, count(*) over () as total from c)
      where total <= 100 or n > 300""",
    "cache_clear": """
      select count(distinct md5(text)) as cleared, 0::bigint as found
      from documents join labels using (doc_id) where quality = 1""",
    "cache_fresh": """
      select md5(text) as text_key, min(doc_id) as inserted_seq from documents group by 1
      having min(doc_id) * 60 > 9 * 3600 - 3600""",
    "similarity": f"""
      select cast(vec_id as varchar) as id, round({cosine('embedding', 'qv')}, 6) as score
      from embeddings join ({MEAN_VECTORS}) on label = query_id""",
    "normalized": """
      select cast(vec_id as varchar) as id, cast(len(embedding) as bigint) as dimension, 1.0::double as length,
             round(((embedding[1] * 3::float)::double
               / sqrt(list_sum(list_transform(embedding, lambda x: (x * 3::float)::double * (x * 3::float)::double))))::float::double, 5) as first
      from embeddings""",
    "topk_single": f"""
      with q as (
        select list(x order by pos) as qv from (
          select pos, round(avg(x::double), 6) as x
          from (select unnest(range(1, len(embedding) + 1)) as pos, unnest(embedding) as x from embeddings)
          group by pos))
      select rank, document_id, id as chunk_id, round(score, 6) as score, cast(label as bigint) as label,
             cast(null as integer) as page_number, cast(null as varchar) as section_title
      from (select *, row_number() over (order by score desc, id) as rank
            from (select v.*, round({cosine('qv', 'vals')}, 9) as score from {VECTORS} v, q where namespace = 'low'))
      where rank <= 7""",
    "topk_batch": topk_sql(EXACT),
    "topk_blocks": topk_sql(
        f"select a.vec_id as query_id, cast(b.vec_id as varchar) as id, {cosine('a.embedding', 'b.embedding')} as raw "
        "from embeddings a, embeddings b"
    ),
    "filtered_topk": topk_sql(
        f"""
        select query_id, id, {cosine('qv', 'vals')} as raw
        from ({MEAN_VECTORS}) q join {VECTORS} v
          on v.namespace = case when query_id < 5 then 'low' else 'high' end
        where label in (1, 8, 6) and round({cosine('qv', 'vals')}, 9) >= 0.1""",
        "8",
    ),
    "approximate_topk": topk_sql(APPROXIMATE),
    "approximate_recall": f"""
      with near as ({topk_sql(APPROXIMATE)}), exact as ({topk_sql(EXACT)})
      select count(*) as exact_hits, count(n.id) as found_hits, round(count(n.id) / count(*), 6) as recall
      from exact e left join near n on e.query_id = n.query_id and e.id = n.id""",
    "inverted_topk": topk_sql(EXACT),
    "inverted_recall": "select count(*) * least(5, count(*)) as exact_hits, true as reached from embeddings",
    "search_rejects": """
      select distinct cast(label as bigint) as query_id, 'default' as namespace,
             cast(case when label = 5 then 0 when label < 2 then 9 else 5 end as bigint) as top_k,
             case when label in (3, 7) then 'vector size' else 'top_k' end as reason
      from embeddings where label in (3, 5, 7)""",
    "compacted": f"""
      select namespace, id, document_id,
             round((case when label = 0 then vals[1] * 2::float when label >= 3 then -vals[1] else vals[1] end)::double, 6) as first_value,
             cast(label as bigint) as label
      from {VECTORS}
      where label = 0 or not (namespace = 'low' and id in (select cast(doc_id as varchar) from labels where quality = 0))
        and label <> 8""",
    "upsert_rejects": f"""
      select namespace, id, case label when 3 then 'wrong dimension' else 'missing values' end as reject_reason,
             (select count(*) from embeddings where label not in (3, 4)) as taken
      from {VECTORS} where label in (3, 4)""",
    "upsert": f"""
      select namespace, id, document_id, round((case when label >= 3 then -vals[1] else vals[1] end)::double, 6) as first_value,
             cast(label as bigint) as label
      from {VECTORS}
      union all
      select namespace, 'new-' || id, document_id, round(vals[1]::double, 6), cast(label as bigint)
      from {VECTORS} where label < 3""",
    "delete_ids": f"""
      {RECORD} from {VECTORS}
      where not (namespace = 'low' and id in (select cast(doc_id as varchar) from labels where quality = 0))""",
    "delete_filter": f"{RECORD} from {VECTORS} where not (namespace = 'high' and label >= 7 and label < 9)",
    "delete_document": f"{RECORD} from {VECTORS} where not (namespace = 'low' and document_id = 'd3')",
    "delete_all": f"{RECORD} from {VECTORS} where namespace <> 'low'",
    "fetch": f"""
      {RECORD} from {VECTORS}
      where namespace = 'low' and id in (select cast(doc_id as varchar) from labels)""",
    "index_stats": f"""
      select namespace, count(*) as vector_count, cast(max(len(vals)) as bigint) as dimension
      from {VECTORS} group by rollup (namespace)""",
    "stats_history": f"""
      select namespace, count(*) as vector_count, '2024-01-01 00:05:00' as measured_at
      from {VECTORS} group by rollup (namespace)""",
    "stats_refresh": f"""
      select 1::bigint as seq, namespace, count(*) as vector_count from {VECTORS} where label < 6 group by rollup (namespace)
      union all
      select 3, namespace, count(*) from {VECTORS} where label <> 5 group by rollup (namespace)
      union all
      select 5, namespace, count(*) from {VECTORS} where label = 1 or label >= 5 group by rollup (namespace)""",
    "vector_contract": """
      select cast(vec_id as varchar) as id,
             case label when 3 then 'wrong dimension' when 4 then 'missing values' end as reject_reason
      from embeddings""",
    "semantic_search": search_sql(
        """select query_id, rank, document_id, chunk_id, content, round(score, 6) as score,
             cast(null as integer) as page_number, cast(null as varchar) as section_title from hits"""
    ),
    "search_totals": search_sql(
        """select item_id as query_id, text as query, count(h.chunk_id) as total_results
           from benchmark b left join hits h on h.query_id = b.item_id group by item_id, text""",
        threshold=0.75,
    ),
    "reranked": search_sql(
        """, tok as (
          select h.*, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) as qt,
                 regexp_extract_all(lower(h.content), '[a-z0-9]+') as ct
          from hits h join benchmark b on b.item_id = h.query_id),
        shared as (
          select *, case when len(qt) = 0 then 0.0::double else len(list_intersect(qt, ct))::double / len(qt) end as r
          from tok)
        select query_id, row_number() over (partition by query_id order by r desc, score desc, chunk_id) as rank,
               chunk_id, round(r, 6) as rerank_score, round(score, 6) as score from shared"""
    ),
    "source_references": search_sql(
        f"""select h.query_id, h.rank, h.document_id, d.name as document_name,
             substr(h.content, 1, 200) as snippet, round(h.score, 6) as relevance_score
           from hits h join (select cast(doc_id as varchar) as document_id, {FILENAME} as name from documents) d
             using (document_id)"""
    ),
    "valid_queries": """
      select conv_id, turn, reasons = '' as valid, reasons, agent_valid from (
        select conv_id, turn, len(text) between 1 and 2000 as agent_valid,
               concat_ws(',', case when not len(text) between 1 and 1000 then 'query length' end,
                         case when not turn * 20 between 1 and 50 then 'top_k' end,
                         case when not turn / 4 between 0 and 1 then 'similarity_threshold' end) as reasons
        from conversations)""",
    "conversation_context": f"""
      select conv_id, string_agg(role || ': ' || text, {NL} order by turn) as context
      from (select *, row_number() over (partition by conv_id order by turn desc, role, text) as n from conversations)
      where n <= 3 group by conv_id""",
    "token_usage": f"""
      select kind, cast(sum(n) as bigint) as tokens from (
        select case when role = 'user' then 'prompt_tokens' else 'completion_tokens' end as kind, {words('text')} as n
        from conversations
        union all select 'total_tokens', {words('text')} from conversations)
      group by kind""",
    "catalog": f"""
      with u as materialized (select *, {UPLOAD_ID} as upload_id from {UPLOADS}),
      readable as materialized (select upload_id as document_id, content as original from u where error_message is null),
      good as materialized (select document_id, original, redacted as content
                            from ({redacted('readable', 'document_id', 'original')}) join readable using (document_id)),
      made as (select document_id, count(*) as n from ({chunk_sql('good')}) group by 1),
      found as ({found_categories('good', 'document_id', 'original')})
      select upload_id as document_id, filename, file_type, cast(strlen(text) as bigint) as file_size,
             cast(null as integer) as page_count,
             case when error_message is null then {words('content')} end as word_count,
             coalesce(n, 0) as chunk_count, categories_found is not null as has_pii,
             coalesce(categories_found, '') as pii_categories_found, {stamp(CREATED)} as created_at,
             case when error_message is null then 'completed' else 'failed' end as status, error_message,
             false as has_tree_index
      from u left join made on made.document_id = upload_id left join found on found.document_id = upload_id""",
    "catalog_page": f"""
      select document_id, {stamp('created_at')} as created_at, total, total > 45 as has_more
      from (select *, row_number() over (order by created_at desc, document_id) as n, count(*) over () as total
            from {LISTING})
      where n > 30 and n <= 45""",
    "stored_catalog": f"""
      with {STORED}
      select upload_id as document_id, filename, 'default' as namespace,
             case when error_message is null then {words('content')} end as word_count,
             coalesce(n, 0) as chunk_count, categories_found is not null as has_pii,
             coalesce(categories_found, '') as pii_categories_found, {stamp(CREATED)} as created_at,
             case when error_message is null then 'completed' else 'failed' end as status, error_message
      from u left join made on made.document_id = upload_id left join found on found.document_id = upload_id""",
    "catalog_cursor": f"""
      select upload_id as document_id, {stamp(CREATED)} as created_at
      from (select *, row_number() over (order by {CREATED} desc, upload_id) as n
            from (select *, {UPLOAD_ID} as upload_id from {UPLOADS}))
      where n > 30 and n <= 45""",
    "stored_deletion": f"""
      with {STORED},
      gone as (select upload_id from u where error_message is not null or upload_id in (select document_id from found))
      select upload_id as document_id, n as chunks, n as vectors, (select count(*) from gone) as deleted
      from u left join made on made.document_id = upload_id
      where upload_id not in (select upload_id from gone)""",
    "document_details": f"""
      select document_id, source from {LISTING}
      where document_id in (select cast(doc_id as varchar) from labels where toxic = 1)""",
    "deletion_report": f"""
      select document_id, document_id in (select document_id from {LISTING}) as deleted,
             case when document_id in (select document_id from {LISTING}) then 'Document deleted'
                  else 'Document not found' end as message
      from {REQUEST}""",
    "documents_left": f"""
      select document_id, count(*) as chunk_count from ({CHUNKS})
      where document_id not in (select document_id from {REQUEST}) group by 1""",
    "status_fold": f"""
      select id, status, error, progress, {stamp('created_at')} as created_at,
             {stamp('started_at')} as started_at, {stamp('completed_at')} as completed_at
      from {STATES}""",
    "status_counts": f"""
      select count(*) filter (status = 'pending') as pending, count(*) filter (status = 'processing') as processing,
             count(*) filter (status = 'completed') as completed, count(*) filter (status = 'failed') as failed
      from {STATES}""",
    "expired_uploads": f"""
      select '/in/' || substr(filename, 2) as path, cast(strlen(text) as bigint) as length
      from {UPLOADS} where {CREATED} < timestamp '2024-01-01 11:00:00'""",
    "stream_chunks": CHUNKS,
    "stream_index": f"""
      with raw as materialized (select distinct * from {STREAM_DOCS}),
      src as materialized (select document_id, filename, redacted as content
                           from ({redacted('raw', 'document_id', 'content')}) join raw using (document_id))
      select c.chunk_id as id, document_id, 'default' as namespace, src.filename, c.content,
             cast(null as varchar) as missing
      from ({chunk_sql('src')}) c join src using (document_id)""",
    "stream_replay": f"""
      with raw as materialized (
        select distinct * from (
          select * from {STREAM_DOCS}
          union all
          select substr(sha256(content || filename), 1, 16), filename, content
          from (select 'b' || cast(item_id as varchar) || '.txt' as filename, replace(text, {NL}, {NL} || {NL}) as content
                from benchmark))),
      src as materialized (select document_id, filename, redacted as content
                           from ({redacted('raw', 'document_id', 'content')}) join raw using (document_id))
      select c.chunk_id as id, src.filename, c.content, 2::bigint as batches
      from ({chunk_sql('src')}) c join src using (document_id)""",
    "stream_unique": "select distinct substr(sha256(text), 1, 16) as document_id from documents",
    "stream_status": f"""
      select {stamp("time_bucket(interval '5 minutes', ts)")} as start, status, count(*) as events
      from {STATUS} group by all""",
    "stream_late": f"""
      with span as (select epoch_us(min(ts)) as a, epoch_us(max(ts)) as b from events),
      dealt as materialized (
        select s.*, least(3, cast(floor((epoch_us(ts) - a) * 4 / (b - a + 1)) as bigint)
                          + case when seq % 10 = 0 then 1 else 0 end) as batch
        from {STATUS} s, span),
      marks as (
        select n as batch, (select max(ts) from dealt where batch < n) - interval '10 minutes' as mark
        from range(4) r(n)),
      flagged as (select d.*, coalesce(ts < mark, false) as late from dealt d join marks using (batch))
      select {stamp("time_bucket(interval '5 minutes', ts)")} as start, status,
             count(*) filter (not late) as events, count(*) filter (late) as late_events
      from flagged group by 1, 2""",
}
