"""Requests, references, evaluation sets and metrics logs as DataFrames; writers for what is made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quintet.functions.features import DIMS, Q, V, features, parse_time, partition_key, quantize, quantized
from quintet.functions.responses import response_json
from quintet.sources.scratch import kept


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_TEXT, _FLOAT, _INT, _BOOL = T.StringType(), T.FloatType(), T.IntegerType(), T.BooleanType()
REQUEST = _struct(
    id=_TEXT,
    transaction=_struct(amount=_FLOAT, installments=_INT, requested_at=_TEXT),
    customer=_struct(avg_amount=_FLOAT, tx_count_24h=_INT, known_merchants=T.ArrayType(_TEXT)),
    merchant=_struct(id=_TEXT, mcc=_TEXT, avg_amount=_FLOAT),
    terminal=_struct(is_online=_BOOL, card_present=_BOOL, km_from_home=_FLOAT),
    last_transaction=_struct(timestamp=_TEXT, km_from_current=_FLOAT),
)
PARTS = ["transaction", "customer", "merchant", "terminal", "last_transaction"]
_CORRUPT = "_corrupt"


def is_malformed(request: Column, corrupt: Column) -> Column:
    """Text that is no JSON object of the schema, negative counts, or times that can't be read."""
    last = request["last_transaction"]
    bad = [
        request.isNull(),
        corrupt.isNotNull(),
        F.coalesce(request["transaction"]["installments"] < 0, F.lit(False)),
        F.coalesce(request["customer"]["tx_count_24h"] < 0, F.lit(False)),
        parse_time(request["transaction"]["requested_at"]).isNull(),
        last.isNotNull() & parse_time(last["timestamp"]).isNull(),
    ]
    out = bad[0]
    for x in bad[1:]:
        out = out | x
    return out


def parse_requests(df: DataFrame, text: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """The parts of each JSON request, and ``malformed``; fields that the schema does not name are skipped."""
    schema = T.StructType([*REQUEST.fields, T.StructField(_CORRUPT, T.StringType())])
    body = F.trim(F.col(text))
    parsed = F.when(body != "", F.from_json(body, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}))
    rows = df.select(*keep, parsed.alias("r"))
    return rows.select(*keep, F.col("r.id").alias("id"), *(F.col(f"r.{p}").alias(p) for p in PARTS), is_malformed(F.col("r"), F.col(f"r.{_CORRUPT}")).alias("malformed"))


def vectors(requests: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """q0..q13 and the partition key of request rows."""
    q = quantized(requests.select(*keep, *features()))
    return q.withColumn("part", partition_key())


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of requests."""
    return parse_requests(spark.read.text(path))


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """``(ref_id, q0..q13, label, part)`` of a JSON array of ``{"vector": [..14..], "label": "fraud" | ..}``, gzip or not.

    Rows need both fields and at least 14 values, of which more are ignored. A gzip
    file is one split; write the result once with ``write_references``.
    """
    raw = spark.read.schema("vector ARRAY<FLOAT>, label STRING").option("multiLine", True).json(path)
    rows = raw.where((F.size("vector") >= DIMS) & F.col("label").isNotNull())
    rows = rows.select(*(quantize(F.element_at("vector", i + 1)).alias(Q[i]) for i in range(DIMS)), (F.col("label") == "fraud").cast("byte").alias("label"))
    # sorted rows, so that ids, which settle ties, are those of the contents however the files are read; rows alike in all are interchangeable
    rows = kept(rows.orderBy(*Q, "label").withColumn("_at", F.monotonically_increasing_id()), "references")
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    q = rows.join(F.broadcast(before), part == F.col("_p")).select((F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("ref_id"), *Q, "label")
    return q.withColumn("part", partition_key())


def write_references(refs: DataFrame, path: str) -> None:
    """References as Parquet by partition key, so a reader prunes the partitions it does not need."""
    n = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    refs.repartitionByRange(n, "part", "ref_id").sortWithinPartitions("part", "ref_id").write.partitionBy("part").mode("overwrite").parquet(path)


def open_references(spark: SparkSession, path: str) -> DataFrame:
    """References written before; raises ValueError if their schema is another."""
    df = spark.read.parquet(path)
    if missing := {"ref_id", "label", "part", *Q} - set(df.columns):
        raise ValueError(f"no reference table: {sorted(missing)} missing")
    return df


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """``(entry_id, id, <request parts>, expected_approved, expected_fraud_score)`` of an evaluation file's entries."""
    inner = REQUEST.simpleString()
    raw = spark.read.schema(f"entries ARRAY<STRUCT<request: {inner}, expected_approved: BOOLEAN, expected_fraud_score: DOUBLE>>").option("multiLine", True).json(path)
    rows = raw.select(F.posexplode("entries").alias("entry_id", "e"))
    return rows.select("entry_id", F.col("e.request.id").alias("id"), *(F.col(f"e.request.{p}").alias(p) for p in PARTS), "e.expected_approved", "e.expected_fraud_score")


def read_evaluation_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row with the figures that an evaluation file states of its entries."""
    raw = spark.read.schema("stats STRUCT<total: LONG, fraud_count: LONG, fraud_rate: DOUBLE, legit_count: LONG, legit_rate: DOUBLE, edge_case_rate: DOUBLE>").option("multiLine", True).json(path)
    return raw.select("stats.*")


def synthetic_vectors(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """Uniform vectors in [-1, 1] for warming up, v0..v13."""
    return spark.range(n).select(F.col("id").alias("ref_id"), *((F.rand(seed + i) * 2 - 1).cast("float").alias(V[i]) for i in range(DIMS)))


def read_result_log(spark: SparkSession, path: str, prefix: str = "k6", most: int = 40) -> DataFrame:
    """``(line_no, line)``: the last ``most`` lines of the JSON blocks in a container's log.

    Lines that begin with the prefix and a bar count, without these. A block goes from a line ``{`` to the next line ``}``. A
    log is one small file, whose lines are taken in order.
    """
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", "\r?\n")).alias("at", "value")).where(F.col("value").rlike(rf"^{prefix}[^|]*\|"))
    lines = lines.select("at", F.regexp_replace("value", r"^[^|]*\| ?", "").alias("line"))
    order = W.orderBy("at")
    lines = lines.withColumn("opened", F.sum((F.col("line") == "{").cast("int")).over(order))
    block = W.partitionBy("opened")
    inside = lines.withColumn("ends", F.min(F.when(F.col("line") == "}", F.col("at"))).over(block)).where((F.col("opened") > 0) & (F.col("at") <= F.col("ends")))
    last = inside.orderBy(F.desc("at")).limit(most)
    return last.select((F.row_number().over(order)).alias("line_no"), "line")


def write_model(spark: SparkSession, nodes: list[tuple[int, int, int, int, int]], leaf_frauds: list[int], path: str) -> None:
    """A decision tree as tables: nodes (node, feature, threshold, left, right; a child below 0 is leaf ``-1 - child``) and leaves (leaf, frauds)."""
    spark.createDataFrame(nodes, "node int, feature int, threshold int, left int, right int").coalesce(1).write.mode("overwrite").json(f"{path}/nodes")
    spark.createDataFrame(list(enumerate(leaf_frauds)), "leaf int, frauds int").coalesce(1).write.mode("overwrite").json(f"{path}/leaves")


def read_model(spark: SparkSession, path: str, most: int = 100_000) -> tuple[list[tuple[int, int, int, int, int]], DataFrame]:
    """The nodes, at most so many, and the leaves' table of a tree that ``write_model`` or another program wrote as JSON lines.

    Raises ValueError if a child is missing, a node is reached twice or a leaf has no count.
    """
    rows = spark.read.schema("node int, feature int, threshold int, left int, right int").json(f"{path}/nodes").limit(most + 1).collect()
    leaves = spark.read.schema("leaf int, frauds int").json(f"{path}/leaves")
    nodes = [tuple(r) for r in sorted(rows)]
    if len(nodes) > most:
        raise ValueError(f"over {most} nodes")
    kids = [c for n in nodes for c in n[3:]]
    inner, ends = sorted(c for c in kids if c >= 0), sorted(-1 - c for c in kids if c < 0)
    if inner != sorted(n[0] for n in nodes if n[0] != 0) or len(set(ends)) != len(ends) or len(nodes) != len({n[0] for n in nodes}):
        raise ValueError("the nodes are no tree")
    if sorted(r["leaf"] for r in leaves.limit(most + 2).collect()) != (ends or [0]):
        raise ValueError("leaves and counts differ")
    return nodes, leaves


def write_responses(scored: DataFrame, path: str) -> None:
    scored.select("id", response_json(F.col("frauds")).alias("response")).write.mode("overwrite").json(path)


def write_rules(rules: DataFrame, path: str) -> None:
    """A rule table (safe leaves or pairs, a few hundred rows) as one JSON file, in order of its columns."""
    rules.coalesce(1).sortWithinPartitions(*rules.columns).write.mode("overwrite").json(path)


def read_rules(spark: SparkSession, path: str, schema: str = "leaf int, part int, n long, verdict int") -> DataFrame:
    """Rules written before."""
    return spark.read.schema(schema).json(path)


def write_result(row: DataFrame, path: str) -> None:
    """An evaluation's one row as a JSON file."""
    row.coalesce(1).write.mode("overwrite").json(path)


def requests_from_events(events: DataFrame) -> DataFrame:
    """Transactions made of the ``events`` table: event_id, the parts of a request, and label (1 for an error event).

    Amounts are whole cents, so all aggregates are exact. A user's earlier events give the last
    transaction, the count of 24 hours and the known merchants. There are at most 40 merchants, so their
    averages are an aggregate that is joined by broadcast; users' windows share one shuffle.
    """
    cents = F.round(F.col("value") * 100).cast("long")
    k = F.get_json_object("props", "$.k").cast("int")
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    base = events.select("event_id", "user_id", "event_type", cents.alias("cents"), F.concat(F.lit("MERC-"), F.pmod(k, F.lit(40)).cast("string")).alias("merch"), F.pmod(k, F.lit(12)).alias("m"), F.col("ts").cast("timestamp_ntz").alias("ts"), seconds.alias("sec"))
    mcc = "CASE m WHEN 0 THEN '5411' WHEN 1 THEN '5812' WHEN 2 THEN '5912' WHEN 3 THEN '5944' WHEN 4 THEN '7801' WHEN 5 THEN '7802' WHEN 6 THEN '7995' WHEN 7 THEN '4511' WHEN 8 THEN '5311' WHEN 9 THEN '5999' WHEN 10 THEN '9999' ELSE '123' END"
    return events.sparkSession.sql(f"""
      WITH of_merchant AS (
        SELECT merch AS name, CAST(CAST(sum(cents) AS DOUBLE) / CAST(5 * count(*) AS DOUBLE) AS FLOAT) AS merch_avg FROM {{base}} GROUP BY merch),
      w AS (
        SELECT *,
          CAST(CAST(sum(cents) OVER (PARTITION BY user_id) AS DOUBLE) / CAST(5 * count(*) OVER (PARTITION BY user_id) AS DOUBLE) AS FLOAT) AS user_avg,
          CAST(count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) - 1 AS INT) AS tx24,
          lag(merch, 1) OVER u AS m1, lag(merch, 2) OVER u AS m2, lag(merch, 3) OVER u AS m3,
          lag(ts) OVER u AS last_ts, lag(cents) OVER u AS last_cents
        FROM {{base}} WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id))
      SELECT /*+ BROADCAST(of_merchant) */ event_id, CAST(event_id AS STRING) AS id,
        named_struct('amount', CAST(CAST(cents AS DOUBLE) / 5 AS FLOAT), 'installments', CAST(event_id % 14 AS INT), 'requested_at', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")) AS transaction,
        named_struct('avg_amount', user_avg, 'tx_count_24h', tx24, 'known_merchants', filter(array(m1, m2, m3), x -> x IS NOT NULL)) AS customer,
        named_struct('id', merch, 'mcc', {mcc}, 'avg_amount', merch_avg) AS merchant,
        named_struct('is_online', event_type IN ('view', 'click'), 'card_present', event_type = 'purchase', 'km_from_home', CAST(CAST(cents AS DOUBLE) / 25 AS FLOAT)) AS terminal,
        CASE WHEN last_ts IS NOT NULL THEN named_struct('timestamp', date_format(last_ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), 'km_from_current', CAST(CAST(abs(cents - last_cents) AS DOUBLE) / 20 AS FLOAT)) END AS last_transaction,
        CAST(event_type = 'error' AS TINYINT) AS label
      FROM w LEFT JOIN of_merchant ON merch <=> name""", base=base)


def references_from_events(events: DataFrame) -> DataFrame:
    """``(ref_id, q0..q13, label, part)``: every event as a labelled reference."""
    rows = requests_from_events(events)
    return vectors(rows, ("event_id", "label")).withColumnRenamed("event_id", "ref_id")
