"""Mixing sources to target weights by hash order and distributed prefix sums; DataFrame operations only.

A document's key is the MD5 of its id and a seed, so reruns agree. Keys cut
the unit interval of each source in ranges, about ``ranges`` in all, more
for a larger source, so a hot one is split as well, and more for a large table. Ranges are
sorted on their own; the words before a range are a prefix sum over ranges,
those before a document one within its range. Sizes and keys are written to
the shared folder once, as three steps read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quintet.llm.common import SPACE_WORD, materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
#: Ranges of keys over all sources, about, and documents of a range on average at most: beyond both products there are more ranges.
#: Their sums are added up in blocks of so many, and then over blocks.
RANGES = 16_384
RANGE_DOCS = 100_000
BLOCK = 128


def n_words(text: Column) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+``; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``(source, source_size, n_docs, all_docs, target)``: words that each source is to give; one row for each source.

    ``share`` of all words goes to the sources by weight (given in turn to the
    sources by code point, null last), no source over ``cap`` times its size.
    With sources by cap over weight, the ones that reach their cap come
    first; the others share what these leave. This is where resharing the
    excess again and again ends.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long")).withColumn("most", F.lit(cap).cast("long") * F.col("source_size"))
    order = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(1))
    per = per.withColumn("total", F.lit(share) * F.sum("source_size").over(whole)).withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0)))
    per = per.withColumn("level", F.col("left") / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    # the first source, in this order, that the level does not fill sets the level of all after it
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), "source", F.col("level").alias("level")))).over(whole)
    reached = F.coalesce(level["level"] * F.col("weight"), F.col("most").cast("double"))
    return per.select("source", "source_size", "n_docs", F.sum("n_docs").over(whole).alias("all_docs"), F.least(reached, F.col("most").cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = "", ranges: int = RANGES, whole_documents: bool = False, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` for every row of ``docs``.

    taken is the number of words the mix takes: every whole epoch of the source
    that fits in its target, then documents in key order up to the target,
    cut within the last one (its first words). With ``whole_documents`` the
    last one is taken if its middle lies before the cut, else left.
    Null text: size 0. A null source is a source of its own. Ties of key and
    id go by size; rows that tie in all are alike, so any order gives one
    result. Other columns are not read. An empty table gives an empty one.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    sized = sized.withColumn("key", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    sized = materialize(sized, "sizes")
    goal = targets(sized, weights, share, cap)
    at = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    placed = sized.join(goal, sized["source"].eqNullSafe(goal["source"]), "inner").drop(goal["source"]).withColumn("bucket", F.floor(at * F.ceil(F.col("n_docs") * F.greatest(F.lit(float(ranges)), F.col("all_docs") / RANGE_DOCS) / F.col("all_docs"))).cast("long"))
    own = W.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_first(), "size")
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    # the words before a range: of blocks before its own, and of ranges before it in its block
    sums = sums.withColumn("block", F.floor(F.col("bucket") / BLOCK))
    blocks = sums.groupBy("source", "block").agg(F.sum("words").alias("words"))
    upto = lambda *keys: W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(F.col("source").alias("s"), F.col("block").alias("k"), F.coalesce(F.sum("words").over(upto("source").orderBy("block")), F.lit(0)).alias("earlier"))
    sums = sums.withColumn("inner", F.coalesce(F.sum("words").over(upto("source", "block").orderBy("bucket")), F.lit(0)))
    sums = sums.join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k"))).select("s", F.col("bucket").alias("b"), (F.col("earlier") + F.col("inner")).alias("before"))
    run = placed.withColumn("within", F.sum("size").over(own.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    run = run.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    goal_words = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal_words / F.col("source_size"))).otherwise(0)
    rest = goal_words - epochs * F.col("source_size") - F.col("before") - F.col("within")
    part = F.when(2 * rest > F.col("size"), F.col("size")).otherwise(0) if whole_documents else F.greatest(F.lit(0), F.least(F.col("size"), rest))
    columns = ["doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken")]
    if whole_documents:
        columns.append((epochs + F.when(2 * rest > F.col("size"), 1).otherwise(0)).cast("int").alias("copies"))
    return run.select(*columns)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, with all its columns, as often as the mix takes them whole.

    Rows that repeat an id, or have none, are taken alike, as often as the one of them taken most.
    """
    said = mix(docs, whole_documents=True, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    said = said.groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").alias("_copies")).where("_copies > 0")
    own, extra = [docs[c] for c in docs.columns], "_".join(["", *docs.columns])
    return docs.join(said, docs[id_col].cast("long").eqNullSafe(said["_id"])).select(*own, F.explode(F.sequence(F.lit(1), said["_copies"])).alias(extra)).drop(extra)


#: DuckDB SQL of ``mix`` with its defaults.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS k
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 2 * source_size AS most,
    (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(COALESCE(sum(2 * source_size) OVER w, 0) AS DOUBLE))
      / CAST(sum(weight) OVER () - COALESCE(sum(weight) OVER w, 0) AS DOUBLE) AS level,
    row_number() OVER (ORDER BY 2 * source_size / weight, source NULLS LAST) AS turn
  FROM per
  WINDOW w AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, source_size,
    least(COALESCE((SELECT arg_min(level, turn) FROM levels WHERE level * weight <= most) * weight, CAST(most AS DOUBLE)), CAST(most AS DOUBLE)) AS target
  FROM levels),
run AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, CAST(floor(g.target) AS BIGINT) AS words,
    CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS before
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (words // source_size) * size + greatest(0, least(size, words % source_size - before)) END AS BIGINT) AS taken
FROM run
"""
