"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

Sources in code-point order (null last) get repeating weights and share a budget of words;
a source is asked for ``max_epochs`` times its words at most, and what it cannot take is
shared among the others by weight until none is above. Each document draws an exponential key
scaled by its quality weight (``-ln(u) / w``, u from a hash of its id and the seed). A source
first takes whole epochs of itself, then documents in the order of their keys until the rest of
its budget is met; the document at the border is taken if more than half of it fits.

Keys are cut into cells by a monotone function; cell sums tell in which cell the border
lies, so only documents of that cell are ranked, however large the source is. The number of cells
grows with the root of the number of rows, so neither a source's cells nor one cell's documents
are many.

Cases: null or empty texts have size 0 and are taken 0 words; they come once with every whole
epoch of their source and never in its fractional one, so no row comes more than ``max_epochs``
times; a source without words has target 0 and no copies; a null source is a source of its own, the last; equal keys fall back to the id,
then to the text's hash; an empty table gives an empty result; null quality counts as 1.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import Scratch

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
#: Least number of cells that the keys of a source are cut into; one cell per source is ranked row by row.
CELLS = 1024


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of ``parts``."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``target`` for each row of ``sizes`` (source, source_size): water-filling in closed form.

    Sources fill up in the order of cap over weight. If the first k are full, the level of the
    rest is (budget - their caps) / (weight of the rest); k is the largest number for which the
    k-th source is full at the level it would set. One row per source: the windows are small.
    """
    whole = Window.partitionBy()
    ranked = sizes.withColumn("__rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    table = F.array(*(F.lit(float(w)) for w in weights))
    ranked = ranked.withColumn("__w", F.element_at(table, (F.col("__rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("__cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("__budget", F.sum("source_size").over(whole) * F.lit(float(share)))
    filling = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("__rank"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("__caps", F.coalesce(F.sum("__cap").over(before), F.lit(0.0))).withColumn("__left", F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("__full", F.col("__cap") * F.col("__left") <= F.col("__w") * (F.col("__budget") - F.col("__caps")))
    level = F.max(F.when(~F.col("__full"), F.struct((-F.col("__cap") / F.col("__w")).alias("a"), (-F.col("__rank")).alias("b"), F.col("__caps").alias("caps"), F.col("__left").alias("left")))).over(whole)
    ranked = ranked.withColumn("__level", level)
    open_target = (F.col("__budget") - F.col("__level.caps")) * F.col("__w") / F.col("__level.left")
    target = F.when(F.col("__full"), F.col("__cap")).otherwise(F.least(F.col("__cap"), open_target))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", quality: DataFrame | None = None, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = 42) -> DataFrame:
    """doc_id, __tie (a hash of the text), size, source, source_size, target, copies and taken of every row.

    ``quality`` (doc_id, weight) scales the keys; a document without a weight has 1.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__tie"))
    if quality is not None:
        once = quality.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("weight").cast("double").alias("__q"))
        rows = rows.join(once, "doc_id", "left")
    else:
        rows = rows.withColumn("__q", F.lit(None).cast("double"))
    w = F.when(F.col("__q") > 0, F.col("__q")).otherwise(F.lit(1.0))
    rows = rows.withColumn("__key", -F.log(unit(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("__tie"), F.lit(seed))) / w).drop("__q")
    rows = scratch.save(rows, "keyed")
    cells = max(CELLS, 8 * math.isqrt(rows.count()))
    rows = rows.withColumn("__cell", F.floor((F.lit(1.0) - F.exp(-F.col("__key"))) * cells).cast("int"))

    by_cell = scratch.save(rows.groupBy("source", "__cell").agg(F.sum("size").alias("__cell_size")), "cells")
    wanted = targets(by_cell.groupBy("source").agg(F.sum("__cell_size").alias("source_size")), weights, share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0)
    wanted = wanted.withColumn("__epochs", epochs.cast("long")).withColumn("__rest", F.col("target") - F.col("__epochs") * F.col("source_size"))
    running = Window.partitionBy("source").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    borders = by_cell.withColumn("__start", F.coalesce(F.sum("__cell_size").over(running), F.lit(0)).cast("long"))
    borders = borders.join(wanted.withColumn("__s", named).drop("source"), named == F.col("__s"))
    # the border cell is the first whose end goes beyond the rest of the budget
    border = F.min(F.when(F.col("__start") + F.col("__cell_size") > F.col("__rest"), F.struct("__cell", "__start")))
    # a written table has a size, so Spark broadcasts it if it is small and shuffles otherwise
    plan = scratch.save(borders.groupBy("__s", "source_size", "target", "__epochs", "__rest").agg(border.alias("__border")), "plan")

    rows = rows.withColumn("__name", named).join(plan, F.col("__name") == F.col("__s"))
    cell = F.coalesce(F.col("__border.__cell"), F.lit(cells))
    ordered = Window.partitionBy("__name").orderBy("__key", "doc_id", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    kept = ("doc_id", "__tie", "size", "source", "source_size", "target")
    # the fractional epoch is of rows with words, and there is none once all epochs are whole
    more = (F.col("size") > 0) & (F.col("__epochs") < max_epochs)
    clear = rows.where(F.col("__cell") != cell).select(*kept, (F.col("__epochs") + ((F.col("__cell") < cell) & more).cast("long")).alias("copies"))
    near = rows.where(F.col("__cell") == cell)
    start = F.col("__border.__start") + F.coalesce(F.sum("size").over(ordered), F.lit(0))
    near = near.withColumn("__at", start).select(*kept, (F.col("__epochs") + ((F.col("__at") + F.col("size") / 2 <= F.col("__rest")) & more).cast("long")).alias("copies"))
    return clear.unionByName(near).withColumn("taken", F.col("copies") * F.col("size"))


def apply(docs: DataFrame, decided: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as ``decided`` (from mix()) has copies of it."""
    per_row = decided.groupBy("doc_id", "__tie").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("__copies"))
    per_row = per_row.withColumnsRenamed({"doc_id": "__id", "__tie": "__mark"})
    marked = docs.withColumn("__text_hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = marked.join(per_row, F.col(key).eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__mark")))
    single = joined.where(F.size("__copies") == 1).withColumn("__n", F.element_at("__copies", 1))
    # rows of one id and text share their copies out in any order: they are alike
    turn = Window.partitionBy("__id", "__mark").orderBy(F.lit(1))
    again = joined.where(F.size("__copies") > 1).withColumn("__n", F.element_at("__copies", F.row_number().over(turn)))
    rows = single.unionByName(again).where("__n > 0")
    return rows.withColumn("__each", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))
