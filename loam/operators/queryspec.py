"""The query language, parsed on the driver: site:, title:, inurl:, before:, after:, phrases and exclusion."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass, field
from datetime import datetime, timezone

from loam.functions import fixed_values as V

_TOKEN = re.compile(r"[^\W_]+", re.UNICODE)
SEARCHED = ("title", "body", "description")


@dataclass(frozen=True)
class Clause:
    """Terms that must (or must not) stand together in one of the fields."""

    terms: tuple[str, ...]
    fields: tuple[str, ...] = SEARCHED
    negative: bool = False


@dataclass
class QuerySpec:
    text: str = ""
    sites: list[str] = field(default_factory=list)
    not_sites: list[str] = field(default_factory=list)
    inurl: list[str] = field(default_factory=list)
    before: int | None = None
    after: int | None = None

    @property
    def has_operators(self) -> bool:
        return bool(self.sites or self.not_sites or self.inurl or self.before is not None or self.after is not None)


def tokens_of(query: str) -> list[str]:
    """Words between white space; quoted phrases stay whole, with their quotes."""
    return re.findall(r'(?:[^\s"]|"[^"]*(?:"|$))+', query)


def parse_epoch(text: str, end: bool) -> int | None:
    """Epoch of a year, month or day: its first second or, with ``end``, its last."""
    m = re.fullmatch(r"(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?", text)
    if not m or not 1970 <= int(m[1]) <= 2200:
        return None
    year, month, day = int(m[1]), int(m[2] or (12 if end else 1)), m[3]
    try:
        last = calendar.monthrange(year, month)[1]
        when = datetime(year, month, int(day) if day else (last if end else 1), *((23, 59, 59) if end else ()), tzinfo=timezone.utc)
    except (ValueError, calendar.IllegalMonthError):
        return None
    return int(when.timestamp())


def parse(query: str) -> QuerySpec:
    """Operators of a query and what is left as text."""
    spec, rest = QuerySpec(), []
    for token in tokens_of(query):
        negative = len(token) > 1 and token[0] == "-"
        name, colon, value = token[negative:].partition(":")
        name = name.lower() if colon else ""
        epoch = parse_epoch(value, name == "before") if name in ("before", "after") else None
        if name == "site" and value:
            (spec.not_sites if negative else spec.sites).append(value.strip('"').lower())
        elif name == "intitle" and value:
            rest.append(("-" if negative else "") + "title:" + value)
        elif name == "inurl" and value:
            spec.inurl.append(value.lower())
        elif name == "before" and epoch is not None:
            spec.before = epoch
        elif name == "after" and epoch is not None:
            spec.after = epoch
        else:
            rest.append(token)
    spec.text = " ".join(rest)
    return spec


def strip_unknown_fields(text: str) -> str:
    """``word:rest`` becomes ``rest`` unless word is a field of the index."""
    out = []
    for token in tokens_of(text):
        m = re.fullmatch(r"(-?)([A-Za-z0-9_]+):(.+)", token, re.DOTALL)
        out.append(m[1] + m[3] if m and m[2].lower() not in V.FIELDS else token)
    return " ".join(out)


def sanitize(text: str) -> str:
    """Letters, digits, - and _ of each word."""
    kept = ("".join(c for c in t if c.isalnum() or c in "-_") for t in tokens_of(text))
    return " ".join(k for k in kept if k)


def clauses(text: str) -> list[Clause]:
    """Clauses of a text without operators: all positive ones must match."""
    out = []
    for token in tokens_of(strip_unknown_fields(text)):
        negative, body = (True, token[1:]) if token[0] == "-" and len(token) > 1 else (False, token)
        name, colon, rest = body.partition(":")
        fields = SEARCHED
        if colon and name.lower() in SEARCHED:
            fields, body = (name.lower(),), rest
        terms = tuple(t.lower() for t in _TOKEN.findall(body) if len(t.encode()) <= 40)
        if terms:
            out.append(Clause(terms, fields, negative))
    return out


def query_terms(text: str) -> list[str]:
    """Words in lower case, without what is no letter or digit at their ends."""
    return [t for w in text.split() if (t := re.sub(r"^[\W_]+|[\W_]+$", "", w).lower())]


def is_newsy(text: str) -> bool:
    return any(w in text.lower() for w in V.NEWS_WORDS)


def navigational(text: str) -> str | None:
    """The one word of 4 to 20 bytes of a query that may name a site."""
    words = ["".join(c for c in w if c.isalnum()) for w in text.lower().split()]
    named = [w for w in words if 4 <= len(w.encode()) <= 20]
    return named[0] if len(named) == 1 else None
