"""Evaluation: predictions against expectations, latencies, and the final score."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quintet.functions.responses import detection_score, p99_score, percent_floor, text_width, weighted_error, xml_escape

#: Values of which one aggregate may hold all.
HELD = 1_000_000


def judge(predictions: DataFrame, expected: DataFrame, key: str = "entry_id") -> DataFrame:
    """``(key, expected, approved)`` for every row of ``expected(key, expected)``: the prediction of the same key, null if it has none.

    Of several predictions of one key the denial counts, so a repeated answer makes one row.
    """
    said = predictions.groupBy(key).agg(F.min("approved").alias("approved"))
    return expected.select(key, "expected").join(said, key, "left").select(key, "expected", "approved")


def percentiles(rows: DataFrame, column: str, shares: list[float], keys: tuple[str, ...] = (), held: int = HELD) -> DataFrame:
    """``(keys, p)``: exact percentiles by linear interpolation, an array in the order of ``shares``; null without values.

    Groups of up to ``held`` values are aggregated whole. In larger ones, sketches narrow the range that the
    wanted ranks lie in, and rows below it are counted, again and again until a range holds few
    values; only these are gathered. The groups' figures come to the driver, so they are to be few.
    """
    spark = rows.sparkSession
    v = rows.select(*keys, F.col(column).cast("double").alias("_v")).where("_v is not null")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    sizes = {tuple(r)[:-1]: r["_n"] for r in v.groupBy(*keys).agg(F.count("*").alias("_n")).collect()}
    if max(sizes.values(), default=0) <= held:
        return v.groupBy(*keys).agg(F.percentile("_v", F.array(*map(F.lit, shares))).alias("p")) if sizes or not keys else rows.select(*keys).limit(0).withColumn("p", F.lit(None).cast("array<double>"))
    ranks = {k: sorted({x for s in shares for x in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))}) for k, n in sizes.items() if n}
    todo = {(k, x): (-math.inf, math.inf, 0, sizes[k]) for k in ranks for x in ranks[k]}  # range, values before it and in it
    value: dict[tuple, float] = {}
    grid = [i / 256 for i in range(257)]

    def among(these: dict) -> DataFrame:
        wanted = spark.createDataFrame([(*k, x, float(lo), float(hi)) for (k, x), (lo, hi, *_) in these.items()], f"{kinds + ', ' if kinds else ''}_x long, _lo double, _hi double")
        same = F.lit(True)
        for c in keys:
            same = same & v[c].eqNullSafe(wanted[c])
        return v.join(F.broadcast(wanted), same & (v["_v"] >= wanted["_lo"]) & (v["_v"] <= wanted["_hi"])).select(*(wanted[c] for c in keys), "_x", "_lo", "_hi", "_v")

    while todo:
        few = {t: b for t, b in todo.items() if b[3] <= held}
        if few:
            for r in among(few).groupBy(*keys, "_x").agg(F.sort_array(F.collect_list("_v")).alias("_all")).select(*keys, "_x", F.col("_all")).collect():
                t = (tuple(r)[: len(keys)], r["_x"])
                value[t] = r["_all"][r["_x"] - few[t][2]]
            todo = {t: b for t, b in todo.items() if t not in few}
            continue
        ranges = {}
        for r in among(todo).groupBy(*keys, "_x").agg(F.percentile_approx("_v", F.array(*map(F.lit, grid)), 100_000).alias("_g")).collect():
            t = (tuple(r)[: len(keys)], r["_x"])
            lo, hi, before, n = todo[t]
            at = (t[1] - before) / n * 256
            ranges[t] = (r["_g"][max(0, math.floor(at) - 1)], r["_g"][min(256, math.ceil(at) + 1)])
        counted = among({t: (*ranges[t], 0, 0) for t in todo})
        inside = {(tuple(r)[: len(keys)], r["_x"]): r["_n"] for r in counted.groupBy(*keys, "_x").agg(F.count("*").alias("_n")).collect()}
        below = {(tuple(r)[: len(keys)], r["_x"]): r["_n"] for r in among({t: (-math.inf, math.nextafter(ranges[t][0], -math.inf), 0, 0) for t in todo}).groupBy(*keys, "_x").agg(F.count("*").alias("_n")).collect()}
        for t in list(todo):
            lo, hi = ranges[t]
            if lo == hi:
                value[t] = lo
                del todo[t]
            elif (lo, hi) == todo[t][:2]:
                raise RuntimeError("percentiles did not narrow")
            else:
                todo[t] = (lo, hi, below.get(t, 0), inside[t])
    out = []
    for k, n in sizes.items():
        at = [s * (n - 1) for s in shares]
        out.append((*k, [value[k, math.floor(x)] + (x - math.floor(x)) * (value[k, math.ceil(x)] - value[k, math.floor(x)]) for x in at]))
    return spark.createDataFrame(out, f"{kinds + ', ' if kinds else ''}p array<double>")


def confusion(rows: DataFrame) -> DataFrame:
    """``(tp, tn, fp, fn, err, n)`` of ``rows(expected, approved)``; positive is a denied fraud, a null prediction an error."""
    e, a = F.col("expected"), F.col("approved")
    return rows.agg(F.count_if(~e & ~a).alias("tp"), F.count_if(e & a).alias("tn"), F.count_if(e & ~a).alias("fp"), F.count_if(~e & a).alias("fn"), F.count_if(a.isNull()).alias("err"), F.count("*").alias("n"))


def latency(rows: DataFrame, column: str = "ms") -> DataFrame:
    """The exact 99th percentile, by linear interpolation."""
    return percentiles(rows, column, [0.99]).select(F.col("p")[0].alias("p99"))


def final_score(counts: DataFrame, p99: DataFrame) -> DataFrame:
    """One row with the weighted error, its rate, and the scores, rounded to two decimals."""
    row = counts.crossJoin(p99)  # one row each
    error = weighted_error(F.col("fp"), F.col("fn"), F.col("err"))
    failures = (F.col("fp") + F.col("fn") + F.col("err")) / F.col("n")
    row = row.select("*", error.alias("weighted_error"), (error / F.col("n")).alias("error_rate"), failures.alias("failure_rate"))
    row = row.select("*", p99_score(F.col("p99")).alias("p99_score"), detection_score(F.col("error_rate"), F.col("weighted_error"), F.col("failure_rate")).alias("detection_score"))
    return row.select("n", "weighted_error", *(F.round(c, 6).alias(c) for c in ("error_rate", "failure_rate")), *(F.round(c, 2).alias(c) for c in ("p99", "p99_score", "detection_score")), F.round(F.col("p99_score") + F.col("detection_score"), 2).alias("final_score"))


def dataset_stats(rows: DataFrame) -> DataFrame:
    """Counts and rates of frauds in ``rows(label, edge)``."""
    n = F.count("*")
    return rows.agg(n.alias("total"), F.count_if(F.col("label") == 1).alias("fraud_count"), F.count_if(F.col("label") == 0).alias("legit_count"), F.round(F.avg(F.col("label").cast("double")), 6).alias("fraud_rate"), F.round(F.avg((F.col("label") == 0).cast("double")), 6).alias("legit_rate"), F.round(F.avg(F.col("edge").cast("double")), 6).alias("edge_case_rate"))


def checks(rows: DataFrame, tests: dict[str, object]) -> DataFrame:
    """``(name, passes, fails, percent, ok)`` of boolean columns by name; ok if all pass."""
    per = rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.coalesce(v, F.lit(False)).alias("good")) for k, v in tests.items()))).alias("c")).select("c.*")
    out = per.groupBy("name").agg(F.count_if("good").alias("passes"), F.count_if(~F.col("good")).alias("fails"))
    return out.select("name", "passes", "fails", percent_floor(F.col("passes"), F.col("passes") + F.col("fails")).alias("percent"), (F.col("fails") == 0).alias("ok"))


def summary(rows: DataFrame, kind: str, column: str, keys: tuple[str, ...] = (), seconds: float | None = None) -> DataFrame:
    """A metric's figures, for each value of ``keys``: counter (count, sum, and rate a second), gauge (last by ``at``, min, max), rate (share), or trend (percentiles)."""
    c = F.col(column)
    if kind == "trend":
        plain = rows.groupBy(*keys).agg(F.count(c).alias("n"), F.avg(c).alias("avg"), F.min(c).alias("min"), F.max(c).alias("max"))
        p = percentiles(rows, column, [0.5, 0.9, 0.95], keys)
        same = F.lit(True)
        for k in keys:
            same = same & plain[k].eqNullSafe(p[k])
        return plain.join(p, same, "left").select(*(plain[k] for k in keys), "n", "avg", "min", F.col("p")[0].alias("med"), "max", F.col("p")[1].alias("p90"), F.col("p")[2].alias("p95"))
    figures = {
        "counter": lambda: [F.count(c).alias("count"), F.sum(c).alias("sum"), *([(F.count(c) / F.lit(float(seconds))).alias("per_second")] if seconds else [])],
        "gauge": lambda: [F.max_by(c, "at").alias("value"), F.min(c).alias("min"), F.max(c).alias("max")],
        "rate": lambda: [F.count_if(c).alias("passes"), F.count_if(~c).alias("fails"), F.avg(c.cast("double")).alias("rate")],
    }
    return rows.groupBy(*keys).agg(*figures[kind]())


def text_summary(metrics: DataFrame) -> DataFrame:
    """``(name, line)`` of ``metrics(name, ok, values)``, a line for each metric: a mark, its name, dots, and its values in columns.

    ``ok`` is whether its thresholds hold, null if it has none. Metrics are few: widths are aggregates of all of them.
    """
    wide = metrics.select("name", "ok", F.posexplode("values").alias("at", "value")).withColumn("width", text_width(F.col("value")))
    columns = wide.groupBy("at").agg(F.max("width").alias("most"))
    cells = wide.join(F.broadcast(columns), "at").select("name", "ok", "at", F.concat("value", F.repeat(F.lit(" "), F.col("most") - F.col("width"))).alias("cell"))
    lines = cells.groupBy("name", "ok").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "cell"))), lambda x: x["cell"]), " ").alias("said"))
    longest = lines.agg(F.max(text_width(F.col("name"))).alias("longest"))
    dots = F.repeat(F.lit("."), F.col("longest") - text_width(F.col("name")) + 3)
    mark = F.when(F.col("ok").isNull(), " ").when(F.col("ok"), "✓").otherwise("✗")
    return lines.join(F.broadcast(longest)).select("name", F.rtrim(F.concat(mark, F.lit(" "), "name", dots, F.lit(": "), "said")).alias("line"))


def junit(checked: DataFrame, suite: str = "checks") -> DataFrame:
    """One row with a JUnit document of ``checks``: a case for each, failed if one check did."""
    case = F.concat(F.lit('<testcase name="'), xml_escape(F.col("name")), F.when(F.col("ok"), F.lit('"/>')).otherwise(F.concat(F.lit('"><failure message="'), F.col("fails").cast("string"), F.lit(' failed"/></testcase>'))))
    body = checked.agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("bad"), F.array_join(F.array_sort(F.collect_list(case)), "\n").alias("cases"))
    return body.select(F.format_string('<?xml version="1.0"?>\n<testsuites tests="%d" failures="%d">\n<testsuite name="' + suite + '" tests="%d" failures="%d">\n%s\n</testsuite>\n</testsuites>', "n", "bad", "n", "bad", "cases").alias("xml"))
