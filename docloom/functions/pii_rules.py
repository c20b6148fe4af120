"""Personal-data patterns, categories and tags."""

from __future__ import annotations

from dataclasses import dataclass

from docloom.functions.text import SPACE

# Text patterns here see Unicode: \d is any decimal digit, a word character is any
# letter, number or underscore, and white space is the class of functions.text.
FLAGS = "(?iU)"
WORD_SET = r"\p{L}\p{N}_"
SPACE_SET = r"\s\x1c-\x1f"
BEFORE = rf"(?<![{WORD_SET}])"
AFTER = rf"(?![{WORD_SET}])"
EDGE = rf"(?:(?<=[{WORD_SET}]){AFTER}|{BEFORE}(?=[{WORD_SET}]))"


@dataclass(frozen=True)
class Rule:
    """``lead`` is matched but not reported; ``value`` is the reported span.

    ``within`` narrows a match to its own leading part and drops it where that
    part is missing. ``gates`` are cheap tests, all of which a text with a hit
    passes; most texts stop there.
    """

    category: str
    value: str
    gates: tuple[str, ...]
    lead: str = ""
    tail: str = ""
    within: str | None = None

    @property
    def regex(self) -> str:
        return f"{FLAGS}{self.lead}{self.value}{self.tail}"

    @property
    def gap_regex(self) -> str:
        """The text since the previous match, as group 1, and a match.

        Anchored where the last match ended, so the tail of a text is tried once.
        """
        return f"(?s){FLAGS}\\G(.*?){self.lead}{self.value}{self.tail}"


# The parts of the rules below; they are the contract.
_SET_TO = rf"{SPACE}*[:=]{SPACE}*['\"]?"
_SECRET = rf"[^{SPACE_SET}'\"]+"
_KEY = r"[a-zA-Z0-9_-]{20,}"
_QUOTE = r"['\"]?"
_STREETS = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct"

_PASS = (r"(?iu)p(?:ass|wd)",)
_KEYS = (r"(?iu)k(?:ey|en|-)",)
_DIGITS = (r"\p{Nd}{4}",)

# What counts as personal data, in category and pattern order.
RULES = (
    Rule("password", _SECRET, _PASS, lead=f"password{_SET_TO}", tail=_QUOTE),
    Rule("password", _SECRET, _PASS, lead=f"pwd{_SET_TO}", tail=_QUOTE),
    Rule("password", _SECRET, _PASS, lead=f"pass{_SET_TO}", tail=_QUOTE),
    Rule("api_key", _KEY, _KEYS, lead=f"api[_-]?key{_SET_TO}", tail=_QUOTE),
    Rule("api_key", _KEY, _KEYS, lead=f"secret[_-]?key{_SET_TO}", tail=_QUOTE),
    Rule("api_key", _KEY, _KEYS, lead=f"access[_-]?token{_SET_TO}", tail=_QUOTE),
    Rule("api_key", r"sk-[a-zA-Z0-9]{32,}", _KEYS),
    Rule("api_key", r"pk-[a-zA-Z0-9]{32,}", _KEYS),
    Rule("api_key", r"AIza[a-zA-Z0-9_-]{35}", (r"(?iu)aiza",)),
    Rule(
        "credit_card",
        rf"{BEFORE}(?:4[0-9]{{12}}(?:[0-9]{{3}})?|5[1-5][0-9]{{14}}|3[47][0-9]{{13}}"
        rf"|6(?:011|5[0-9]{{2}})[0-9]{{12}}){AFTER}",
        (r"[0-9]{13}",),
    ),
    Rule("ssn", rf"{BEFORE}\d{{3}}[-{SPACE_SET}]?\d{{2}}[-{SPACE_SET}]?\d{{4}}{AFTER}", _DIGITS),
    Rule("email", rf"{EDGE}[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}{EDGE}", ("@",)),
    Rule(
        "phone",
        rf"{EDGE}(?:\+?1[-.{SPACE_SET}]?)?\(?[2-9]\d{{2}}\)?[-.{SPACE_SET}]?\d{{3}}"
        rf"[-.{SPACE_SET}]?\d{{4}}{AFTER}",
        _DIGITS,
    ),
    Rule(
        "phone",
        rf"{BEFORE}\d{{3}}[-.{SPACE_SET}]\d{{3}}[-.{SPACE_SET}]\d{{4}}{AFTER}",
        _DIGITS,
    ),
    # A house number and words up to a street word. The match takes the whole run of
    # words in one possessive step and is then cut after its last street word: one
    # pass over the text, where backtracking from every number would be quadratic.
    Rule(
        "address",
        rf"{BEFORE}\d{{1,5}}{SPACE}+[{WORD_SET}][{WORD_SET}{SPACE_SET}]*+",
        (rf"{FLAGS}\d{SPACE}", rf"{FLAGS}{SPACE}(?:{_STREETS}){AFTER}"),
        within=rf"{FLAGS}^\d{{1,5}}{SPACE}+[{WORD_SET}][{WORD_SET}{SPACE_SET}]*"
        rf"{SPACE}(?:{_STREETS}){AFTER}",
    ),
)

# Any lead, and the value that follows it, at the start of a match.
LEADS = f"{FLAGS}^(?:" + "|".join(r.lead for r in RULES if r.lead) + ")"
LED_VALUE = f"{FLAGS}^{_SECRET}"

# Labels an external extractor may use, and their category.
EXTRACTION_CLASSES = {
    "password": "password",
    "credential": "password",
    "api_key": "api_key",
    "access_token": "api_key",
    "secret": "api_key",
    "credit_card": "credit_card",
    "card_number": "credit_card",
    "ssn": "ssn",
    "social_security": "ssn",
    "email": "email",
    "phone": "phone",
    "phone_number": "phone",
    "address": "address",
}

# How a detection names its origin, and how sure it is.
REGEX_SOURCE, REGEX_CONFIDENCE = "regex", 0.8
MODEL_SOURCE, MODEL_CONFIDENCE = "langextract", 0.9
