"""Scalar functions of a transaction: 14 normalised features, their int16 form, and the 8-bit partition key.

All are Column expressions, so Catalyst prunes and compiles them. Single-precision
semantics are kept by casting back to FLOAT after every quotient.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 14
Q = [f"q{i}" for i in range(DIMS)]
V = [f"v{i}" for i in range(DIMS)]

# Scales of the features, and of the int16 form.
MAX_AMOUNT, MAX_INSTALLMENTS, AMOUNT_RATIO = 10000, 12, 10
MAX_MINUTES, MAX_KM, MAX_TX_24H, MAX_MERCHANT = 1440, 1000, 20, 10000
SCALE = 10000
KNOWN_MOST = 16
MCC_RISK = {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50}
MCC_DEFAULT = 0.50


def f32(x: float) -> Column:
    return F.lit(x).cast("float")


def quot(a: Column, b: Column | float) -> Column:
    """The single-precision quotient; null for a zero divisor."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.try_divide(a.cast("double"), b.cast("double")).cast("float")


def clamp01(x: Column) -> Column:
    return F.greatest(f32(0), F.least(f32(1), x))


def mcc_risk(code: Column) -> Column:
    risk = F.lit(None)
    for k, v in MCC_RISK.items():
        risk = F.when(code == k, f32(v)).otherwise(risk)
    return F.coalesce(risk.cast("float"), f32(MCC_DEFAULT))


def is_known(merchant: Column, known: Column) -> Column:
    """Whether a merchant is one of the first 16 known ones."""
    return F.coalesce(F.array_contains(F.slice(known, 1, KNOWN_MOST), merchant), F.lit(False))


def parse_time(text: Column) -> Column:
    """A zone-free timestamp of the first 19 characters; null if they are none. Fraction and zone are ignored."""
    return F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")


def epoch_seconds(t: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t)


def minutes_between(now: Column, last: Column) -> Column:
    """Minutes since the last transaction, 0 if it lies ahead."""
    return F.greatest(f32(0), quot(epoch_seconds(now) - epoch_seconds(last), 60))


def flag(x: Column) -> Column:
    return F.when(x, f32(1)).otherwise(f32(0))


def features() -> list[Column]:
    """v0..v13 of a request row with columns transaction, customer, merchant, terminal and last_transaction.

    Missing values count as 0, empty or false. A zero average amount gives
    ratio 1, or 0 for a negative amount. Without a last transaction v5 and v6 are -1.
    """
    c, zero = F.col, f32(0)
    amount = F.coalesce(c("transaction.amount"), zero)
    average = F.coalesce(c("customer.avg_amount"), zero)
    now, last = parse_time(c("transaction.requested_at")), parse_time(c("last_transaction.timestamp"))
    has_last = c("last_transaction").isNotNull()
    minutes = F.coalesce(minutes_between(now, last), zero)
    v = [
        clamp01(quot(amount, MAX_AMOUNT)),
        clamp01(quot(F.coalesce(c("transaction.installments"), F.lit(0)), MAX_INSTALLMENTS)),
        F.when(average == 0, F.when(amount < 0, zero).otherwise(f32(1))).otherwise(clamp01(quot(quot(amount, average), AMOUNT_RATIO))),
        F.coalesce(quot(F.hour(now), 23), zero),
        F.coalesce(quot(F.weekday(now), 6), zero),
        F.when(has_last, clamp01(quot(minutes, MAX_MINUTES))).otherwise(f32(-1)),
        F.when(has_last, clamp01(quot(F.coalesce(c("last_transaction.km_from_current"), zero), MAX_KM))).otherwise(f32(-1)),
        clamp01(quot(F.coalesce(c("terminal.km_from_home"), zero), MAX_KM)),
        clamp01(quot(F.coalesce(c("customer.tx_count_24h"), F.lit(0)), MAX_TX_24H)),
        flag(F.coalesce(c("terminal.is_online"), F.lit(False))),
        flag(F.coalesce(c("terminal.card_present"), F.lit(False))),
        flag(~is_known(F.coalesce(c("merchant.id"), F.lit("")), c("customer.known_merchants"))),
        mcc_risk(F.coalesce(c("merchant.mcc"), F.lit(""))),
        clamp01(quot(F.coalesce(c("merchant.avg_amount"), zero), MAX_MERCHANT)),
    ]
    return [x.alias(n) for x, n in zip(v, V, strict=True)]


def quantize(v: Column) -> Column:
    """An int16 of ten thousandths, rounded half away from zero."""
    return F.round(F.least(f32(SCALE), F.greatest(f32(-SCALE), v * f32(SCALE)))).cast("short")


def quantized(df: DataFrame) -> DataFrame:
    """Replace v0..v13 by q0..q13."""
    keep = [c for c in df.columns if c not in V]
    return df.select(*keep, *(quantize(F.col(v)).alias(q) for v, q in zip(V, Q, strict=True)))


def partition_key() -> Column:
    """The 8-bit key of q0..q13."""
    c = F.col
    risk = F.when(c("q12") <= 2047, 0).when(c("q12") <= 4095, 1).when(c("q12") <= 6143, 2).otherwise(3)
    bits = [(c("q5") >= 0, 0), (c("q9") > 0, 1), (c("q10") > 0, 2), (c("q11") > 0, 3), (c("q2") > 4096, 6), (c("q8") > 2048, 7)]
    key = F.shiftleft(risk, 4)
    for test, at in bits:
        key = key + F.when(test, 1 << at).otherwise(0)
    return key.cast("int")


def distance(a: str, b: str) -> Column:
    """Squared distance of the q columns of two aliases, as a long."""
    total = None
    for q in Q:
        d = F.col(f"{a}.{q}").cast("int") - F.col(f"{b}.{q}").cast("int")
        d = (d * d).cast("long")
        total = d if total is None else total + d
    return total


def box_bound_of(box: Column) -> Column:
    """Least squared distance from a row's q columns to a box, a struct of lo0..lo13, hi0..hi13."""
    total = None
    for i, q in enumerate(Q):
        x = F.col(q).cast("int")
        d = F.greatest(box[f"lo{i}"].cast("int") - x, x - box[f"hi{i}"].cast("int"), F.lit(0))
        d = (d * d).cast("long")
        total = d if total is None else total + d
    return total


def float_distance(a: list[Column], b: list[Column]) -> Column:
    """Squared distance of two lists of single-precision values, summed in double precision."""
    total = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        d = x.cast("double") - y.cast("double")
        total = total + d * d
    return total
