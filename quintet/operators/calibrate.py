"""Calibration: which leaves, and which (leaf, partition) pairs, decide a request without its neighbours.

Entries have a leaf, a partition and the expected decision. A leaf is safe if it has enough entries that
all agree, on the side of its own count; pairs likewise among entries of leaves that are not safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
LEAF_ROWS, PAIR_ROWS, FOLDS, PARTITIONS = 20, 200, 5, 256
PAIR_LEAVES, PAIR_PARTITIONS = (267, 268, 269, 270), (249, 253)


def _support() -> list[Column]:
    return [F.count("*").alias("n"), F.count_if(F.col("approved")).alias("n_approved")]


def leaf_support(entries: DataFrame) -> DataFrame:
    """``(leaf, n, n_approved, least_score, most_score)``."""
    return entries.groupBy("leaf").agg(*_support(), F.min("score").alias("least_score"), F.max("score").alias("most_score"))


def leaf_reasons(entries: DataFrame, leaf_counts: DataFrame, least: int = LEAF_ROWS) -> DataFrame:
    """``(leaf, n, reason)`` for every leaf of ``leaf_counts(leaf, frauds)``: unseen, min_obs, mixed, wrong_side or safe."""
    rows = leaf_counts.join(entries.groupBy("leaf").agg(*_support()), "leaf", "left")
    n, ok = F.coalesce("n", F.lit(0)), F.col("n_approved")
    reason = F.when(n == 0, "unseen").when(n < least, "min_obs").when((ok > 0) & (ok < n), "mixed").when((F.col("frauds") <= 2) != (ok == n), "wrong_side").otherwise("safe")
    return rows.select("leaf", n.cast("long").alias("n"), reason.alias("reason"))


def reason_counts(reasons: DataFrame) -> DataFrame:
    """``(reason, leaves, entries)``."""
    return reasons.groupBy("reason").agg(F.count("*").alias("leaves"), F.sum("n").cast("long").alias("entries"))


def coverage(reasons: DataFrame) -> DataFrame:
    return reasons.agg(F.coalesce(F.sum(F.when(F.col("reason") == "safe", F.col("n"))), F.lit(0)).cast("long").alias("covered"), F.sum("n").cast("long").alias("total"))


def open_entries(entries: DataFrame, reasons: DataFrame) -> DataFrame:
    """Entries of leaves that are not safe: what pairs are calibrated on."""
    safe = reasons.where(F.col("reason") == "safe").select("leaf")
    return entries.join(safe, "leaf", "left_anti")


def pair_support(entries: DataFrame) -> DataFrame:
    """``(leaf, part, n, n_approved)``."""
    return entries.groupBy("leaf", "part").agg(*_support())


def pair_totals(entries: DataFrame) -> DataFrame:
    """Counts by (leaf, part), by leaf and by part in one pass; null marks a column that is summed over."""
    entries.createOrReplaceTempView("_quintet_entries")
    return entries.sparkSession.sql("SELECT leaf, part, count(*) AS n FROM _quintet_entries GROUP BY GROUPING SETS ((leaf, part), (leaf), (part))")


def top(entries: DataFrame, key: str, most: int = 10) -> DataFrame:
    """The keys with the most entries, the smaller key first of equals."""
    return entries.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(most)


def safe_pairs(pairs: DataFrame, least: int = PAIR_ROWS, leaves: tuple[int, ...] | None = PAIR_LEAVES, parts: tuple[int, ...] | None = PAIR_PARTITIONS) -> DataFrame:
    """``(leaf, part, n, verdict)``: pairs with enough entries that all agree; None for leaves or parts means any."""
    rows = pairs.where((F.col("n") >= least) & ((F.col("n_approved") == 0) | (F.col("n_approved") == F.col("n"))))
    if leaves is not None:
        rows = rows.where(F.col("leaf").isin(*leaves))
    if parts is not None:
        rows = rows.where(F.col("part").isin(*parts))
    return rows.select("leaf", "part", "n", F.when(F.col("n_approved") > 0, 0).otherwise(5).alias("verdict"))


def leaf_verdicts(pairs: DataFrame) -> DataFrame:
    """``(leaf, verdict, parts)`` of leaves whose safe pairs all agree."""
    return pairs.groupBy("leaf").agg(F.min("verdict").alias("verdict"), F.max("verdict").alias("_most"), F.count("*").alias("parts")).where("verdict = _most").drop("_most")


def _fires(decided: DataFrame) -> list[Column]:
    said, true = F.col("verdict") <= 2, F.col("approved")
    return [F.count("*").alias("fires"), F.count_if(said & ~true).alias("fn"), F.count_if(~said & true).alias("fp")]


def audit(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(fires, fn, fp)``: what the safe pairs of agreeing leaves would decide, and wrongly."""
    rules = pairs.drop("verdict", "n").join(leaf_verdicts(pairs).select("leaf", "verdict"), "leaf")
    decided = entries.join(rules, ["leaf", "part"])
    return decided.agg(*_fires(decided))


def require_clean(audited: DataFrame) -> DataFrame:
    """Raise ValueError if a rule decided wrongly."""
    row = audited.agg(F.sum("fn").alias("fn"), F.sum("fp").alias("fp")).first()
    if row["fn"] or row["fp"]:
        raise ValueError(f"rules decide wrongly: {row['fn']} wrongly approved, {row['fp']} wrongly denied")
    return audited


def cross_validate(entries: DataFrame, least: int = PAIR_ROWS, folds: int = FOLDS, leaves: tuple[int, ...] | None = PAIR_LEAVES, parts: tuple[int, ...] | None = PAIR_PARTITIONS) -> DataFrame:
    """``(fold, fires, fn, fp)``: pairs found without a fold (entry_id modulo folds), used on it.

    Counts of a fold's complement are totals less the fold's own, so entries are aggregated once.
    """
    own = entries.withColumn("fold", (F.col("entry_id") % folds).cast("int"))
    per = own.groupBy("fold", "leaf", "part").agg(*_support())
    total = per.groupBy("leaf", "part").agg(F.sum("n").alias("t"), F.sum("n_approved").alias("ta"))
    every = entries.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold"))
    rest = total.join(every).join(per, ["fold", "leaf", "part"], "left")  # a row for each pair and fold
    rest = rest.select("fold", "leaf", "part", (F.col("t") - F.coalesce("n", F.lit(0))).alias("n"), (F.col("ta") - F.coalesce("n_approved", F.lit(0))).alias("n_approved"))
    ok = (F.col("n") >= least) & (F.col("n") > 0) & ((F.col("n_approved") == 0) | (F.col("n_approved") == F.col("n")))
    for column, allowed in (("leaf", leaves), ("part", parts)):
        ok = ok if allowed is None else ok & F.col(column).isin(*allowed)
    rules = rest.where(ok).select("fold", "leaf", "part", F.when(F.col("n_approved") > 0, 0).otherwise(5).alias("verdict"))
    held = per.join(rules, ["fold", "leaf", "part"])
    sums = held.groupBy("fold").agg(F.sum("n").cast("long").alias("fires"), F.coalesce(F.sum(F.when(F.col("verdict") <= 2, F.col("n") - F.col("n_approved"))), F.lit(0)).cast("long").alias("fn"), F.coalesce(F.sum(F.when(F.col("verdict") > 2, F.col("n_approved"))), F.lit(0)).cast("long").alias("fp"))
    return every.join(sums, "fold", "left").select("fold", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("fires", "fn", "fp")))


def leaf_bitmap(pairs: DataFrame) -> DataFrame:
    """``(leaf, word, mask)``: partitions of a leaf's pairs as bits of 64-bit words."""
    bits = pairs.select("leaf", F.shiftright("part", 6).alias("word"), F.expr("shiftleft(1L, part & 63)").alias("bit"))
    return bits.groupBy("leaf", "word").agg(F.bit_or("bit").alias("mask"))


def by_bitmap(rows: DataFrame, bitmap: DataFrame) -> DataFrame:
    """Rows whose (leaf, part) is set in the bitmap."""
    keyed = rows.withColumn("word", F.shiftright("part", 6))
    return keyed.join(bitmap, ["leaf", "word"]).where(F.expr("shiftright(mask, part & 63) & 1") == 1).select(rows.columns)


def used_parts(pairs: DataFrame) -> DataFrame:
    return pairs.select("part").distinct()
