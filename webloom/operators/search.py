"""Two-stage search: field-weighted BM25 over a bounded pool, then distinct linking domains.

Both stages read a written ``SearchIndex`` (items, and edges by their anchor text): a query opens
the postings of its own terms and narrow live rows; texts are read for one page of results alone.
All scores are integers (each contribution times a million, rounded) so that ties do not depend on
the order of summation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.operators.index import SearchIndex
from webloom.session import Scratch

FIELD_WEIGHTS = {"title": 10, "description": 3, "full_text": 1}
EDGE_KEYS = ("parent_id", "child_id")
K1, B = 1.2, 0.75
POOL, PAGE, QUERY_LENGTH = 2000, 50, 256


def item_index(scratch: Scratch, name: str = "items") -> SearchIndex:
    """An index over searchable items; ``image`` is the facet and ``inc`` the number of inbound links."""
    return SearchIndex(scratch, name, ("item_id",), tuple(FIELD_WEIGHTS), ("inc", "image"))


def link_index(scratch: Scratch, name: str = "links") -> SearchIndex:
    """An index over edges by anchor text, with the parent's domain and whether the edge leaves the domain."""
    return SearchIndex(scratch, name, EDGE_KEYS, ("description",), ("domain", "external"))


def indexable(items: DataFrame) -> DataFrame:
    """Searchable items with the columns that an index reads."""
    return items.withColumn("image", F.lower("type").startswith("image/"))


def groups(query: str) -> list[tuple[str, ...]]:
    """The query as an OR of terms and phrases; operators vanish."""
    found = []
    for phrase, word in re.findall(r'"([^"]+)"|((?:[^\W_])+)', query.strip()[:QUERY_LENGTH]):
        tokens = re.findall(r"[^\W_]+", (phrase or word).lower())
        if tokens:
            found.append(tuple(tokens))
    return list(dict.fromkeys(found))


def match_expression(query: str) -> str:
    """The same as text: phrases in quotes, parts joined by a bar."""
    parts = []
    for phrase, word in re.findall(r'"([^"]+)"|((?:[^\W_])+)', query.strip()[:QUERY_LENGTH]):
        words = re.findall(r"[^\W_]+", phrase) if phrase else [word]
        if words:
            parts.append('"' + " ".join(words) + '"' if phrase else word)
    return " | ".join(parts)


def _shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def matches(index: SearchIndex, wanted: list[tuple[str, ...]], within: DataFrame | None = None) -> DataFrame:
    """keys, attributes, g (which group), field, dl and tf of every group that occurs in a live row (``within``: of these keys)."""
    keys, out = (*index.keys, *index.attributes), None
    held = index.terms({w for words in wanted for w in words}, within)
    for g, words in enumerate(wanted):
        own = held.where(F.col("term").isin(*set(words)))
        if len(words) == 1:
            part = own.select(*keys, F.lit(g).alias("g"), "field", "dl", F.size("positions").alias("tf"))
        else:
            at = own.groupBy(*keys, "field", "dl").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
            starts = F.col("at")[words[0]]
            for j, w in enumerate(words[1:], 1):
                starts = F.array_intersect(starts, _shifted(F.col("at")[w], j))
            part = at.withColumn("tf", F.size(F.coalesce(starts, F.array().cast("array<int>")))).where("tf > 0").select(*keys, F.lit(g).alias("g"), "field", "dl", "tf")
        out = part if out is None else out.unionByName(part)
    return out


def _contribution(mean: Column) -> Column:
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean))


def content_pool(index: SearchIndex, query: str, images: bool | None = False, limit: int = POOL) -> DataFrame:
    """The ``limit`` best items by relevance, inc, id: only images, only others (the usual search), or all (None)."""
    wanted = groups(query)
    if not wanted:
        return index.live().where(F.lit(False)).select("item_id", "inc", F.lit(0).cast("long").alias("relevance"))
    found = matches(index, wanted)
    df = found.groupBy("g", "field").agg(F.count(F.lit(1)).alias("df"))  # one row per group and field
    weight = F.create_map(*(x for f, w in FIELD_WEIGHTS.items() for x in (F.lit(f), F.lit(float(w)))))
    mean = F.create_map(*(x for f in FIELD_WEIGHTS for x in (F.lit(f), F.col(f"avg_{f}"))))
    asked = found if images is None else found.where(F.col("image") == images)
    scored = asked.join(F.broadcast(df), ["g", "field"]).join(F.broadcast(index.statistics()))
    x = _contribution(mean[F.col("field")])
    rated = scored.groupBy("item_id", "inc").agg(F.sum(F.round(x * weight[F.col("field")] * 1e6).cast("long")).alias("relevance"))
    return rated.orderBy(F.desc("relevance"), F.desc("inc"), "item_id").limit(max(1, min(limit, 10000)))


def external_link_matches(index: SearchIndex, query: str, pool: DataFrame | None = None) -> DataFrame:
    """item_id and the exact number of external domains that link to it with matching text."""
    within = None if pool is None else pool.select(F.col("item_id").alias("child_id"))
    found = matches(index, groups(query), within).where("external = 1")
    return found.groupBy(F.col("child_id").alias("item_id")).agg(F.countDistinct("domain").alias("link_matches"))


def focused_candidates(index: SearchIndex, query: str, limit: int = 10000) -> DataFrame:
    """Children of matching links by best link score; all domains count."""
    found = matches(index, groups(query))
    df = found.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    scored = found.join(F.broadcast(df), "g").join(F.broadcast(index.statistics()))
    per_edge = scored.groupBy(*EDGE_KEYS).agg(F.sum(F.round(_contribution(F.col("avg_description")) * 1e6).cast("long")).alias("w"))
    return per_edge.groupBy("child_id").agg(F.max("w").alias("score")).orderBy(F.desc("score"), "child_id").limit(max(1, min(limit, 10000)))


def first_search_word(query: str) -> str:
    for word in re.sub(r'[+\-~<>()*"]', " ", query).split(" "):
        if len(word) >= 3:
            return word
    return query


def search(items: DataFrame, index: SearchIndex, links: SearchIndex, query: str, images: bool = False, offset: int = 0, page: int = PAGE) -> DataFrame:
    """One page of results (a row more than ``page`` tells that there are more), ranked and hydrated.

    Ranking runs on narrow rows; wide columns join the page's few rows at the end.
    """
    pool = content_pool(index, query, images)
    ranked = pool.join(external_link_matches(links, query, pool), "item_id", "left").withColumn("link_matches", F.coalesce("link_matches", F.lit(0)).cast("long")) if groups(query) else pool.withColumn("link_matches", F.lit(0).cast("long"))
    order = (F.desc("link_matches"), F.desc("relevance"), F.desc("inc"), F.col("item_id"))
    best = ranked.orderBy(*order).offset(max(0, offset)).limit(page + 1)
    best = best.withColumn("position", F.row_number().over(Window.orderBy(*order)) + max(0, offset))  # over one page
    wide = items.select("item_id", "url", "title", "description", "full_text")
    word = first_search_word(query).lower()
    at = F.locate(word, F.lower(F.coalesce("full_text", F.lit(""))))
    return best.join(wide, "item_id").select("position", "item_id", "link_matches", "relevance", "inc", "url", "title", "description", F.when(at > 0, F.substring("full_text", F.greatest(F.lit(1), at - 150), F.lit(400))).alias("snippet"))
