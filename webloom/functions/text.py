"""Text rules as column expressions."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that never count towards the repetition cap
STOPWORDS = (
    "a", "about", "an", "are", "as", "at", "be", "by", "com", "de", "en",
    "for", "from", "how", "i", "in", "is", "it", "la", "of", "on", "or",
    "that", "the", "this", "to", "was", "what", "when", "where", "who",
    "will", "with", "und", "www",
)
CAP = 50
_TRIM = " \t\n\r\x00\x0b"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(_TRIM))


def normalize_whitespace(c: Column) -> Column:
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[\t\x0B\f\r ]+", " ")
    c = F.regexp_replace(c, r" *\n *", "\n")
    return trimmed(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def truncate(c: Column, n: int) -> Column:
    """At most n code points; a cut moves back to a space beyond 80 % and ends in an ellipsis."""
    cut = F.regexp_replace(F.left(c, F.lit(n)), r"[ \t\n\r\x00\x0B]+$", "")
    last = F.length(cut) - F.locate(" ", F.reverse(cut))  # 0-based place of the last space
    back = (F.locate(" ", cut) > 0) & (last > int(n * 0.8))
    shorter = F.regexp_replace(F.substring(cut, F.lit(1), last.cast("int")), r"[ \t\n\r\x00\x0B]+$", "")
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.when(back, shorter).otherwise(cut), F.lit("…")))


_TERM = re.compile(r"[^\W_]+")
_STOP = frozenset(STOPWORDS)


def cap_text(text: str | None, cap: int = CAP) -> str | None:
    """The text without the words that carry a term beyond its ``cap``-th occurrence.

    A word is what stands between single spaces of a line; its terms are its runs of letters and
    digits. A removed word's terms count like all others. The first pass counts only: most texts
    have no term that often and stay as they are.
    """
    if text is None or len(text) <= 3 * cap:
        return text
    counts = Counter(t for t in _TERM.findall(text.lower()) if len(t) >= 3)
    often = {t for t, n in counts.items() if n > cap and t not in _STOP}
    if not often:
        return text
    seen: Counter = Counter()
    lines = []
    for line in text.split("\n"):
        kept = []
        for word in line.split(" "):
            over = False
            for t in _TERM.findall(word.lower()):
                if t in often:
                    seen[t] += 1
                    over |= seen[t] > cap
            if not over:
                kept.append(word)
        lines.append(" ".join(kept))
    return "\n".join(lines)


def capped(c: Column, cap: int = CAP) -> Column:
    """cap_text() over Arrow batches: the decision is local to a row, so nothing is shuffled."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: cap_text(t, cap))

    return run(c)


def snippet(text: Column, word: str) -> tuple[Column, Column]:
    """The place of ``word`` (0: none) and 400 characters around it."""
    at = F.locate(word.lower(), F.lower(text))
    return at, F.when(at > 0, F.substring(text, F.greatest(F.lit(1), at - 150), F.lit(400)))


def display_text(description: Column, cut: Column, at: Column) -> Column:
    """The snippet without its partial first word, else the description."""
    mid = at > 151
    first = F.locate(" ", cut)
    rest = F.when(mid & (first > 0) & (first - 1 < 30), F.substring(cut, first + 1, F.length(cut))).otherwise(cut)
    return F.when(cut.isNull(), truncate(description, 500)).otherwise(F.concat(F.when(mid, "…").otherwise(""), truncate(rest, 380)))


def query_terms(query: str) -> list[str]:
    return list(dict.fromkeys(t for t in query.replace('"', " ").lower().split() if len(t) >= 3))[:8]


def highlight(c: Column, query: str) -> Column:
    """Marks around every term of the query; the earliest match wins, then the first term."""
    terms = query_terms(query)
    if not terms:
        return c
    pattern = "(?i)(" + "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", t) for t in terms) + ")"
    return F.regexp_replace(c, pattern, "<mark>$1</mark>")


def content_type(header: Column) -> tuple[Column, Column]:
    kind = F.lower(trimmed(F.split_part(header, F.lit(";"), F.lit(1))))
    charset = F.regexp_extract(header, r"(?i)charset\s*=\s*\"?([^\";]+)\"?", 1)
    return kind, F.when(charset != "", trimmed(charset))


def type_class(kind: Column) -> Column:
    """html, image, pdf or text; null for other types."""
    return F.when(kind.isin("text/html", "application/xhtml+xml"), "html").when(kind.startswith("image/"), "image").when(kind == "application/pdf", "pdf").when(kind == "text/plain", "text")


def described(description: Column, body: Column) -> Column:
    """The page's own description, else the beginning of its text."""
    return F.coalesce(description, F.left(body, F.lit(500)))


#: Characters of a stored text that a retrieval returns.
RETRIEVED = 120_000


def retrieval_text(body: Column) -> tuple[Column, Column]:
    """The text for a retrieval and whether it was cut (compared in bytes)."""
    whole = F.coalesce(body, F.lit(""))
    cut = F.left(whole, F.lit(RETRIEVED))
    return cut, F.octet_length(whole) > F.octet_length(cut)


def plain_text(body: Column, charset: Column) -> Column:
    """A plain-text body (binary) in its charset (unknown or none: UTF-8), whitespace normalised; empty gives null."""

    @F.pandas_udf("string")
    def run(b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else decode(bytes(x), y) for x, y in zip(b, c)])

    def decode(x: bytes, y: str | None) -> str:
        try:
            return x.decode(y or "utf-8", "replace")
        except LookupError:
            return x.decode("utf-8", "replace")

    clean = normalize_whitespace(run(body, charset))
    return F.when(clean != "", clean)


def robots_tokens(value: Column) -> Column:
    """noindex and nofollow of a robots header or meta; none means both."""
    tokens = F.transform(F.split(F.lower(value), ","), trimmed)
    has = lambda t: F.array_contains(tokens, t) | F.array_contains(tokens, "none")
    return F.struct(F.coalesce(has("noindex"), F.lit(False)).alias("noindex"), F.coalesce(has("nofollow"), F.lit(False)).alias("nofollow"))


def byte_size(c: Column) -> Column:
    """Bytes of "123", "1.5T", "1500GB"; null if malformed or not whole."""
    plain = F.when(c.rlike(r"^[0-9]+$"), c.cast("decimal(38,6)"))
    number = F.regexp_extract(c, r"^([0-9]+(?:\.[0-9]+)?)([GTgt])[Bb]?$", 1)
    unit = F.upper(F.regexp_extract(c, r"^([0-9]+(?:\.[0-9]+)?)([GTgt])[Bb]?$", 2))
    scaled = F.when(number != "", number.cast("decimal(20,6)") * F.when(unit == "T", F.lit(10**12)).otherwise(F.lit(10**9)))
    value = F.coalesce(plain, scaled.cast("decimal(38,6)"))
    return F.when(value == F.floor(value), value.cast("long"))


def content_hash(c: Column) -> Column:
    """SHA-1 of the text that is stored, which is the capped one (``c`` comes through capped())."""
    return F.sha1(F.coalesce(c, F.lit("")).cast("binary"))
