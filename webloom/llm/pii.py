"""Personal data: fixed base patterns, widened by bootstrapped contextual extraction.

Base spans come from four fixed patterns (email, ip, card, phone) and always stay. They are
the seeds of a pattern-instance graph. Instances are base spans, every other token with a digit
or an at sign, and the beginnings of phone-like runs that the base pattern rejects as a whole.
An instance's lexical patterns are its shape (exact and coarse) and what stands around it: the
word before with the signs between, two words before, the second word before with a gap, the
word after; a context counts with the class of the token (address, digits, mixed).

Spark scores the graph for some rounds. A pattern is worth the share of a kind's members among
all that it points at: every other token it meets is a negative. It is trusted if it is worth
``TRUST`` or more and has ``LEAST_MEMBERS`` different members. An unknown instance is believed by
the noisy-or of its trusted patterns; what reaches ``TRUST`` becomes a member, so that identifiers
found in one round support patterns of the next. All occurrences of a member become spans.

Cases: null text is empty and has no span; equal texts get equal spans; a table without seeds
discovers nothing; tokens of any length take part (long ones by a hash); a found span inside
another found one is left out; patterns and instances are aggregated by key with partial sums,
so a frequent context is no hot task. Offsets are code points, the end exclusive. Texts are read
whole.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.arrowtext import chunks
from webloom.session import Scratch

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
LEAST_MEMBERS = 4
TRUST = 0.4
#: Pseudo-instances of score 0 in every pattern.
SHRINK = 0.5
#: Longer surfaces are told apart by their hash.
LONG_SURFACE = 64

# fixed values: the base patterns
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_BACKWARDS = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\s]*[0-9@][^\s]*")
_EDGE = "\"'()[]{}<>.,;:!?"
_WORD = re.compile(r"[^\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
_RUN = re.compile(r"\d+|[^\W\d_]+|[\W_]")
_DIGITS = frozenset("0123456789")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain in linear time: each at sign looks back over its own run."""
    found, last, at = [], 0, text.find("@")
    backwards = None
    while at >= 0:
        if backwards is None:
            backwards = text[::-1]
        run = _LOCAL_BACKWARDS.match(backwards, len(text) - at, len(text) - last)
        if run:
            domain = _DOMAIN.match(text, at + 1)
            if domain:
                found.append((at - (run.end() - run.start()), domain.end()))
                last = domain.end()
        at = text.find("@", max(at + 1, last))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All base spans by start, then kind as listed."""
    spans = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                spans.append(("phone", m.start(), m.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def shape(token: str) -> tuple[str, str]:
    """The form of a token: runs of digits with their length, runs of letters, other signs as they are; and without lengths."""
    exact, coarse = [], []
    for m in _RUN.finditer(token):
        run = m.group()
        if run[0].isdecimal():
            exact.append(f"d{len(run)}" if len(run) <= 24 else "d+")
            coarse.append("d")
        elif run[0].isalpha():
            exact.append("w")
            coarse.append("w")
        else:
            exact.append(run)
            coarse.append(run)
        if len(exact) > 40:  # a form that long is its own
            exact.append(hashlib.sha1(token.encode()).hexdigest())
            return "".join(exact), "".join(coarse)
    return "".join(exact), "".join(coarse)


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of the instance at ``start`` to ``end``: shapes and contexts with the token's class."""
    token = text[start:end]
    exact, coarse = shape(token)
    kind = "@" if "@" in token else "x" if _LETTER.search(token) else "d"
    out = [f"s:{exact}"]
    if any(not c.isalnum() for c in token):  # one run of digits or letters has no form without its length
        out.append(f"c:{coarse}")
    near = max(0, start - 60)
    before = list(_WORD.finditer(text, near, start))[-2:]
    if before:
        last = before[-1]
        between = " ".join(text[last.end() : start].split(" "))
        out.append(f"l{kind}:{last.group().lower()}{between}")
        if len(before) == 2:
            out.append(f"p{kind}:{before[0].group().lower()} {last.group().lower()}")
            out.append(f"g{kind}:{before[0].group().lower()} *")
    after = _WORD.search(text, end, min(len(text), end + 30))
    if after:
        out.append(f"r{kind}:{after.group().lower()}")
    return out


def surface(token: str) -> str:
    token = token.lower()
    return token if len(token) <= LONG_SURFACE else "#" + hashlib.sha1(token.encode()).hexdigest()


def instances(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str | None, int, int]]:
    """Base spans and other identifier-like stretches outside them: kind or None, start, end."""
    out: list[tuple[str | None, int, int]] = list(spans)
    taken = sorted((a, b) for _, a, b in spans)

    def free(a: int, b: int) -> bool:
        i = bisect.bisect_left(taken, (a, a))
        return not any(s < b and a < e for s, e in taken[max(0, i - 4) : i + 4])

    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if b > a and free(a, b):
            out.append((None, a, b))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if sum(c in _DIGITS for c in m.group()) > 15:  # the run holds more than one number
            digits, a = 0, m.start()
            for i in range(a, m.end()):
                digits += text[i] in _DIGITS
                if digits > 15:
                    break
                if text[i] in _DIGITS and text[i + 1 : i + 2] == " " and free(a, i + 1) and digits > 1:
                    out.append((None, a, i + 1))
    return out


SCHEMA = "rid bigint, key {key}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, seen array<struct<kind:string,a:bigint,b:bigint,surface:string,patterns:array<string>>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen_type = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("surface", pa.string()), ("patterns", pa.list_(pa.string()))]))
    for batch in chunks(batches):
        counts, base, seen = [], [], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text) if text else []
            counts.append([sum(s[0] == k for s in spans) for k in KINDS])
            base.append(written(spans))
            seen.append([{"kind": k, "a": a, "b": b, "surface": surface(text[a:b]), "patterns": patterns(text, a, b)} for k, a, b in instances(text, spans)] if text else [])
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("key"), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)), pa.array(base, pa.string()), pa.array(seen, seen_type)], ["rid", "key", "n_email", "n_ip", "n_card", "n_phone", "base", "seen"])


def members(edges: DataFrame, scratch: Scratch, rounds: int = ROUNDS, least: int = LEAST_MEMBERS, trust: float = TRUST) -> DataFrame:
    """surface, kind and score of all seeds and all that the rounds discover.

    ``edges``: pattern, surface, kind (null: unknown). Each round's members are a written table.
    """
    edges = scratch.save(edges.groupBy("pattern", "surface").agg(F.max("kind").alias("kind")), "graph")
    support = scratch.save(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "support")
    seeds = edges.where("kind is not null").groupBy("surface").agg(F.min("kind").alias("kind"), F.lit(1.0).alias("score"))
    known = scratch.save(seeds, "members-0")
    for turn in range(1, rounds + 1):
        held = edges.select("pattern", "surface").join(known.select("surface", "kind"), "surface").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("held"))
        worth = held.where(F.col("held") >= least).join(support, "pattern").withColumn("worth", F.col("held") / (F.col("n") + SHRINK)).where(F.col("worth") >= trust)
        trusted = scratch.save(worth.select("pattern", "kind", "worth"), f"trusted-{turn}")
        doubt = edges.where("kind is null").select("pattern", "surface").join(trusted, "pattern").groupBy("surface", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("worth"))))).alias("score"))
        best = doubt.where(F.col("score") >= trust).groupBy("surface").agg(F.max(F.struct("score", "kind")).alias("b")).select("surface", "b.kind", "b.score")
        known = scratch.save(scratch.load("members-0", known.schema).unionByName(best), f"members-{turn}")
    return known


def find(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, counts of base spans by kind, base (spans as text), spans (base and found) and n_found of every row."""
    scratch = Scratch(docs.sparkSession, "pii")
    picked = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), F.col(text).alias("text"))
    rows = scratch.save(picked.mapInArrow(_scan, SCHEMA.format(key=dict(picked.dtypes)["key"])), "scanned")
    seen = rows.where(F.size("seen") > 0).select("rid", F.explode("seen").alias("s")).select("rid", "s.*")
    known = members(seen.select("surface", "kind", F.explode("patterns").alias("pattern")), scratch)
    found = seen.where("kind is null").select("rid", "a", "b", "surface").join(known.select("surface", F.col("kind").alias("kind")), "surface")
    found = found.groupBy("rid").agg(F.collect_set(F.struct("a", "kind", "b")).alias("more"))
    inside = lambda x: F.exists("more", lambda y: (y["a"] <= x["a"]) & (x["b"] <= y["b"]) & (y["b"] - y["a"] > x["b"] - x["a"]))
    found = found.select("rid", F.filter("more", lambda x: ~inside(x)).alias("more"))
    out = rows.drop("seen").join(found, "rid", "left")
    rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k)
    listed = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.struct(F.split_part(s, F.lit(":"), F.lit(2)).cast("bigint").alias("a"), rank(F.split_part(s, F.lit(":"), F.lit(1))).alias("r"), F.split_part(s, F.lit(":"), F.lit(3)).cast("bigint").alias("b"), F.split_part(s, F.lit(":"), F.lit(1)).alias("kind")))
    extra = F.transform("more", lambda s: F.struct(s["a"].alias("a"), rank(s["kind"]).alias("r"), s["b"].alias("b"), s["kind"].alias("kind")))
    joined = F.array_join(F.transform(F.array_sort(F.concat(listed, extra)), lambda s: F.concat_ws(":", s["kind"], s["a"], s["b"])), ",")
    more = F.coalesce(F.size("more"), F.lit(0)).cast("long")
    return out.select(F.col("key").alias(key), "n_email", "n_ip", "n_card", "n_phone", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(joined).alias("spans"), F.when(more > 0, more).otherwise(0).alias("n_found"))
