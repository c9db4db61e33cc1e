"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import ann, decontaminate, langid, lm, mixing, neardup, pii, sharding, substring, toxicity
from webloom.llm.sampling import per_class, remainder
from webloom.session import Scratch, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(remainder(F.col("doc_id"), 3) != 1), "text", "lang", "doc_id")
    out = langid.predict(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of ``docs`` with a toxicity label (the larger label of an id).

    The ids are thinned to the classifier's bound before they meet the texts, so the side that
    is broadcast has about 2 * ROWS_PER_CLASS rows whatever the input.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    few = per_class(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxic", "doc_id", toxicity.ROWS_PER_CLASS)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(labelled(docs, labels.where(remainder(F.col("doc_id"), 3) != 1)), "text", "toxic", "doc_id")
    out = toxicity.score(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good documents weigh 2, bad ones 1; those without a label weigh 1."""
    return table(spark, sf_dir, "labels").select("doc_id", (F.lit(1.0) + F.coalesce(F.col("quality"), F.lit(0))).alias("weight"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), quality=quality_weights(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_found")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("t")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "lm")
    held_out = remainder(F.col("doc_id"), 5) == 1
    seen = docs.where(~held_out)
    counts = scratch.save(lm.count_tokens(seen), "counts")
    model = lm.train(seen, counts)
    out = lm.score(docs, model, counts, scratch)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.components(table(spark, sf_dir, "documents"), width=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_toxicity": op2_toxicity,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_mixing": op4_mixing,
        "op5_pii": op5_pii,
        "op6_decontamination": op6_decontamination,
        "op7_sharding": op7_sharding,
        "op8_ann": op8_ann,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_near_duplicates": op10_near_duplicates,
    }


_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

_OP3 = f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
  s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
  f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS r FROM s),
  c AS (SELECT DISTINCT doc_id, i + j AS p FROM f, (SELECT unnest(range(0, 20)) AS j) WHERE r > 1),
  o AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w),
  k AS (SELECT o.doc_id, count(*) AS kept, string_agg(o.ws[o.p], ' ' ORDER BY o.p) AS words FROM o ANTI JOIN c ON o.doc_id = c.doc_id AND o.p = c.p GROUP BY o.doc_id)
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.words, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP10 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
  l AS (SELECT b.a, b.b FROM b JOIN n p ON p.doc_id = b.a JOIN n q ON q.doc_id = b.b WHERE 100 * i >= 85 * (p.n + q.n - i)),
  r AS (SELECT doc_id, doc_id AS to_id FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.to_id),
  m AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id)
  SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN m ON m.doc_id = w.doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say what an operator returns; hashes and models are tested by brute force instead."""
    return {"op3_substring_dedup": _OP3, "op10_near_duplicates": _OP10}
