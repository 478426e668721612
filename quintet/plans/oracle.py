"""DuckDB SQL of the queries: the same transactions, features and statistics from ``events``.

Tables of the engine (risks, rules, trees) are written out here once more, so that a wrong value in one of them shows.
"""

from __future__ import annotations

DIMS = 14
I = range(DIMS)
QS = ", ".join(f"q{i}" for i in I)


def _f(x: str) -> str:
    return f"CAST({x} AS FLOAT)"


def _quot(a: str, b: str) -> str:
    return _f(f"CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE)")


def _clamp(x: str) -> str:
    return f"greatest(CAST(0 AS FLOAT), least(CAST(1 AS FLOAT), {x}))"


_MCC = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(("5411", "5812", "5912", "5944", "7801", "7802", "7995", "4511", "5311", "5999", "9999")))
# Fixed values.
_RISK = "WHEN '5411' THEN 0.15 WHEN '5812' THEN 0.30 WHEN '5912' THEN 0.20 WHEN '5944' THEN 0.45 WHEN '7801' THEN 0.80 WHEN '7802' THEN 0.75 WHEN '7995' THEN 0.85 WHEN '4511' THEN 0.35 WHEN '5311' THEN 0.25 WHEN '5999' THEN 0.50"
_FEATURES = [
    _clamp(_quot("amount", "10000")),
    _clamp(_quot("inst", "12")),
    f"CASE WHEN user_avg = 0 THEN CASE WHEN amount < 0 THEN CAST(0 AS FLOAT) ELSE CAST(1 AS FLOAT) END ELSE {_clamp(_quot(_quot('amount', 'NULLIF(user_avg, 0)'), '10'))} END",
    _quot("hour(ts)", "23"),
    _quot("isodow(ts) - 1", "6"),
    f"CASE WHEN last_ts IS NULL THEN CAST(-1 AS FLOAT) ELSE {_clamp(_quot('minutes', '1440'))} END",
    f"CASE WHEN last_ts IS NULL THEN CAST(-1 AS FLOAT) ELSE {_clamp(_quot(_quot('abs(cents - last_cents)', '20'), '1000'))} END",
    _clamp(_quot(_quot("cents", "25"), "1000")),
    _clamp(_quot("tx24", "20")),
    "CASE WHEN event_type IN ('view', 'click') THEN CAST(1 AS FLOAT) ELSE CAST(0 AS FLOAT) END",
    "CASE WHEN event_type = 'purchase' THEN CAST(1 AS FLOAT) ELSE CAST(0 AS FLOAT) END",
    "CASE WHEN known THEN CAST(0 AS FLOAT) ELSE CAST(1 AS FLOAT) END",
    _f(f"CASE mcc {_RISK} ELSE 0.5 END"),
    _clamp(_quot("merch_avg", "10000")),
]
TX = f"""
e AS (
  SELECT event_id, user_id, event_type, ts, value, CAST(round(value * 100) AS BIGINT) AS cents, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
m AS (SELECT *, 'MERC-' || CAST(k % 40 AS VARCHAR) AS merch, CASE k % 12 {_MCC} ELSE '123' END AS mcc FROM e),
w AS (
  SELECT *,
    {_quot('sum(cents) OVER (PARTITION BY user_id)', '5 * count(*) OVER (PARTITION BY user_id)')} AS user_avg,
    {_quot('sum(cents) OVER (PARTITION BY merch)', '5 * count(*) OVER (PARTITION BY merch)')} AS merch_avg,
    count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) - 1 AS tx24,
    lag(merch, 1) OVER u AS m1, lag(merch, 2) OVER u AS m2, lag(merch, 3) OVER u AS m3, lag(ts) OVER u AS last_ts, lag(sec) OVER u AS last_sec, lag(cents) OVER u AS last_cents
  FROM m WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
t AS (
  SELECT *, {_quot('cents', '5')} AS amount, event_id % 14 AS inst, COALESCE(merch IN (m1, m2, m3), false) AS known,
    greatest(CAST(0 AS FLOAT), {_quot('sec - last_sec', '60')}) AS minutes,
    CAST(event_type = 'error' AS INTEGER) AS label
  FROM w),
v AS (SELECT *, {', '.join(f'{x} AS v{i}' for i, x in enumerate(_FEATURES))} FROM t),
q AS (
  SELECT *, {', '.join(f'CAST(round(v{i} * CAST(10000 AS FLOAT)) AS INTEGER) AS q{i}' for i in I)} FROM v),
p AS (
  SELECT *, CAST(CAST(q5 >= 0 AS INTEGER) + 2 * CAST(q9 > 0 AS INTEGER) + 4 * CAST(q10 > 0 AS INTEGER) + 8 * CAST(q11 > 0 AS INTEGER)
    + 16 * (CASE WHEN q12 <= 2047 THEN 0 WHEN q12 <= 4095 THEN 1 WHEN q12 <= 6143 THEN 2 ELSE 3 END)
    + 64 * CAST(q2 > 4096 AS INTEGER) + 128 * CAST(q8 > 2048 AS INTEGER) AS INTEGER) AS part,
    CAST(256 * CAST(q0 > 1000 AS INTEGER) + 128 * CAST(q2 > 1000 AS INTEGER) + 64 * CAST(q11 > 5000 AS INTEGER) + 32 * CAST(q12 > 3000 AS INTEGER)
      + 16 * CAST(q5 > 200 AS INTEGER) + 8 * CAST(q8 > 500 AS INTEGER) + 4 * CAST(q3 > 5000 AS INTEGER) + 2 * CAST(q4 > 5000 AS INTEGER) + CAST(q13 > 300 AS INTEGER) AS INTEGER) AS leaf
  FROM q)"""


def tx(select: str, more: str = "") -> str:
    return f"WITH {TX}{', ' + more if more else ''} {select}"


def dist(a: str, b: str, c: str = "q") -> str:
    return " + ".join(f"CAST(({a}.q{i} - {b}.{c}{i}) AS BIGINT) * ({a}.q{i} - {b}.{c}{i})" for i in I)


BOX = ", ".join(f"CAST(min(q{i}) AS INTEGER) AS lo{i}, CAST(max(q{i}) AS INTEGER) AS hi{i}" for i in I)
BOUND = " + ".join(f"CAST(greatest(b.lo{i} - a.q{i}, a.q{i} - b.hi{i}, 0) AS BIGINT) * greatest(b.lo{i} - a.q{i}, a.q{i} - b.hi{i}, 0)" for i in I)
#: The five nearest events of each event: one number holds distance and id.
NEAR = f"""
z AS MATERIALIZED (SELECT event_id, label, {QS} FROM p),
n AS (SELECT a.event_id AS qid, unnest(min(({dist('a', 'b')}) * 10000000 + b.event_id, 5)) AS key FROM z AS a, z AS b GROUP BY a.event_id),
k AS (SELECT qid, key // 10000000 AS distance, key % 10000000 AS ref_id, row_number() OVER (PARTITION BY qid ORDER BY key) AS rn FROM n),
s AS (SELECT qid, CAST(sum(z.label) AS INTEGER) AS frauds FROM k JOIN z ON z.event_id = k.ref_id GROUP BY qid)"""


# Leaf, conjunction, partition, votes; leaves exclude each other.
_P = "q11 > 5000 AND q3 <= 2826 AND q13 <= 100 AND q12 > 6250 AND q1 > 4584 AND q2 > 6693"
_R = f"{_P} AND q5 > 299 AND q0 <= 3656"
_S = f"{_R} AND q6 <= 4758 AND q7 <= 5270 AND q8 <= 6750"
_LEAVES = [
    (0, "q11 <= 5000 AND q2 <= 666", None, 0),
    (250, f"{_P} AND q5 <= 299", None, 5),
    (264, f"{_S} AND q1 > 7916 AND q1 <= 8750 AND q3 <= 1956", None, 5),
    (266, f"{_S} AND q1 > 8750", None, 5),
    (269, f"{_R} AND q6 > 4758", 253, 5),
    (270, f"{_P} AND q5 > 299 AND q0 > 3656", 249, 5),
]


def rule_leaf() -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {leaf}" for leaf, test, _, _ in _LEAVES) + " END"


def rule_frauds() -> str:
    return "CASE " + " ".join(f"WHEN {test}{f' AND part = {part}' if part is not None else ''} THEN {votes}" for _, test, part, votes in _LEAVES) + " END"


def centroids(n: int) -> str:
    """Fixed centroids."""
    return "c AS (SELECT CAST(j AS INTEGER) AS cluster, " + ", ".join(f"CAST((j * 1237 + {i} * 2711 + j * {i} * 173) % 10001 AS INTEGER) AS c{i}" for i in I) + f" FROM range({n}) AS r(j))"


def ranked(n: int) -> str:
    return f"""{centroids(n)},
d AS (SELECT p.event_id, c.cluster, {dist('p', 'c', 'c')} AS d_centroid, row_number() OVER (PARTITION BY p.event_id ORDER BY {dist('p', 'c', 'c')}, c.cluster) AS rank FROM p, c)"""


ASSIGNED = f"""{ranked(16)},
a AS (SELECT p.*, d.cluster, d.d_centroid FROM p JOIN d USING (event_id) WHERE d.rank = 1)"""


def staged(probes: int, repair: int) -> str:
    """Votes of the staged search: of the nearest clusters that have members, if they are unanimous and near; of more; of all."""
    key = f"({dist('x', 'y')}) * 10000000 + y.event_id"
    return f"""{ASSIGNED},
mine AS MATERIALIZED (SELECT d.event_id, list(rank ORDER BY d.cluster) AS ranks FROM (SELECT event_id, cluster, row_number() OVER (PARTITION BY event_id ORDER BY d_centroid, cluster) AS rank FROM d WHERE cluster IN (SELECT cluster FROM a)) AS d GROUP BY d.event_id),
held AS MATERIALIZED (SELECT event_id, label, {QS}, dense_rank() OVER (ORDER BY cluster) AS place FROM a),
asked AS MATERIALIZED (SELECT * FROM held JOIN mine USING (event_id)),
near AS MATERIALIZED (
  SELECT x.event_id AS qid, min({key}, 5) FILTER (x.ranks[y.place] <= {probes}) AS n1, min({key}, 5) FILTER (x.ranks[y.place] <= {repair}) AS n2, min({key}, 5) AS n3
  FROM asked AS x, held AS y GROUP BY x.event_id),
vote AS (
  SELECT qid, stage, count(*) AS n, CAST(sum(label) AS INTEGER) AS frauds, max(key // 10000000) AS far
  FROM (SELECT qid, 1 AS stage, unnest(n1) AS key FROM near UNION ALL SELECT qid, 2, unnest(n2) FROM near UNION ALL SELECT qid, 3, unnest(n3) FROM near) JOIN held ON held.event_id = key % 10000000
  GROUP BY qid, stage),
s AS (
  SELECT near.qid, CASE WHEN a.n = 5 AND a.frauds IN (0, 5) AND a.far <= 20160000 THEN a.frauds WHEN b.n = 5 AND b.frauds NOT BETWEEN 1 AND 4 THEN b.frauds ELSE e.frauds END AS frauds
  FROM near LEFT JOIN vote AS a ON a.qid = near.qid AND a.stage = 1 LEFT JOIN vote AS b ON b.qid = near.qid AND b.stage = 2 LEFT JOIN vote AS e ON e.qid = near.qid AND e.stage = 3)"""


_WIDEST = "CASE " + " ".join(f"WHEN greatest({', '.join(f'x{j}' for j in I)}) = x{i} THEN {i}" for i in I) + " END"
_VALUE = "CASE d " + " ".join(f"WHEN {i} THEN q{i}" for i in I) + " END"


def forest(levels: int, most: int = 128) -> str:
    """Levels of the forest, one after another: f0 has the roots, and each next one halves of nodes of over ``most`` rows."""
    out = [f"f0 AS MATERIALIZED (SELECT event_id, part, CAST(1 AS BIGINT) AS node, {QS} FROM p)"]
    for k in range(levels):
        out.append(f"""w{k} AS (SELECT part, node, n, {_WIDEST} AS d FROM (SELECT part, node, count(*) AS n, {', '.join(f'max(q{i}) - min(q{i}) AS x{i}' for i in I)} FROM f{k} GROUP BY part, node)),
f{k + 1} AS MATERIALIZED (SELECT event_id, part, CASE WHEN n > {most} THEN 2 * node + CAST(row_number() OVER (PARTITION BY part, node ORDER BY {_VALUE}, event_id) > n // 2 AS BIGINT) ELSE node END AS node, {QS} FROM f{k} JOIN w{k} USING (part, node))""")
    return ", ".join(out)


BLOCKS = """bl AS (SELECT cluster, count(*) AS n, CAST(ceil(count(*) / 8.0) AS BIGINT) AS blocks FROM a GROUP BY cluster),
bo AS (SELECT *, CAST(COALESCE(sum(blocks) OVER (ORDER BY cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block_off FROM bl)"""
REASONS = """g AS (SELECT leaf, count(*) AS n, count(*) FILTER (label = 0) AS ok FROM p GROUP BY leaf),
re AS (
  SELECT l.leaf, COALESCE(n, 0) AS n, CASE WHEN n IS NULL THEN 'unseen' WHEN n < 20 THEN 'min_obs' WHEN ok > 0 AND ok < n THEN 'mixed'
    WHEN (l.leaf % 6 <= 2) <> (ok = n) THEN 'wrong_side' ELSE 'safe' END AS reason
  FROM (SELECT CAST(range AS INTEGER) AS leaf FROM range(512)) AS l LEFT JOIN g USING (leaf))"""
PAIRS = """pp AS (SELECT leaf, part, count(*) AS n, count(*) FILTER (label = 0) AS ok FROM p GROUP BY leaf, part),
sp AS (SELECT leaf, part, n, CASE WHEN ok > 0 THEN 0 ELSE 5 END AS verdict FROM pp WHERE n >= 20 AND (ok = 0 OR ok = n))"""
