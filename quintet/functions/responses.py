"""Responses, scores of an evaluation, and text formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K = 5
APPROVE_MOST = 2
# Fixed values of the evaluation score.
P99_FLOOR_MS, P99_LIMIT_MS, CUT = 1.0, 2000.0, -3000.0
ERROR_FLOOR, FAILURES_MOST, WEIGHT_FN, WEIGHT_ERR = 0.001, 0.15, 3, 5


def frauds_of(votes: Column) -> Column:
    """Votes as 0..5; no votes count as 0."""
    return F.least(F.coalesce(votes, F.lit(0)).cast("int"), F.lit(K))


def approved(frauds: Column) -> Column:
    return frauds <= APPROVE_MOST


def fraud_score(frauds: Column) -> Column:
    return frauds / F.lit(5.0)


def response_json(frauds: Column) -> Column:
    return F.to_json(F.struct(approved(frauds).alias("approved"), fraud_score(frauds).alias("fraud_score")))


def weighted_error(fp: Column, fn: Column, err: Column) -> Column:
    return fp + WEIGHT_FN * fn + WEIGHT_ERR * err


def p99_score(p99: Column) -> Column:
    return F.when(p99 <= 0, 0.0).when(p99 > P99_LIMIT_MS, CUT).otherwise(F.lit(1000.0) * F.log10(F.lit(1000.0) / F.greatest(p99, F.lit(P99_FLOOR_MS))))


def detection_score(rate: Column, error: Column, failures: Column) -> Column:
    score = F.lit(1000.0) * F.log10(F.lit(1.0) / F.greatest(rate, F.lit(ERROR_FLOOR))) - F.lit(300.0) * F.log10(F.lit(1.0) + error)
    return F.when(failures > FAILURES_MOST, CUT).otherwise(score)


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def trimmed_fixed(x: Column, digits: int = 2) -> Column:
    """A number with at most so many decimals, without trailing zeros."""
    return F.regexp_replace(F.format_string(f"%.{digits}f", x.cast("double")), r"\.?0+$", "") if digits else F.format_string("%.0f", x.cast("double"))


def trimmed_cut(x: Column, digits: int = 2) -> Column:
    """The same, with further decimals cut off rather than rounded."""
    x = x.cast("double") * 10**digits
    return trimmed_fixed(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)) / float(10**digits), digits)


def human_bytes(x: Column) -> Column:
    """Bytes in steps of 1000: whole below 10 B, then one decimal below 10 units and none from there on."""
    x = x.cast("double")
    out = F.concat(trimmed_fixed(x, 6), F.lit(" B"))
    for e, unit in enumerate(("B", "kB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")):
        value = F.floor(x / 1000.0**e * 10 + 0.5) / 10.0
        shown = F.concat(F.when(value < 10, F.format_string("%.1f", value)).otherwise(F.format_string("%.0f", value)), F.lit(f" {unit}"))
        out = F.when(x >= max(10.0, 1000.0**e), shown).otherwise(out)
    return out


def human_duration(ms: Column) -> Column:
    """Milliseconds as ns, µs, ms, s, minutes or hours; decimals are cut off."""
    ms = ms.cast("double")
    minutes = F.floor(ms / 60e3)
    seconds = F.concat(trimmed_cut((ms % 60e3) / 1e3, 2), F.lit("s"))
    whole = F.concat(trimmed_cut((ms % 60e3) / 1e3, 0), F.lit("s"))
    long = F.concat(F.when(minutes >= 60, F.format_string("%dh", F.floor(minutes / 60))).otherwise(""), F.format_string("%dm", minutes % 60), F.when(ms > 60e3, whole).otherwise(seconds))
    return (
        F.when(ms == 0, "0s")
        .when(ms < 1e-3, F.concat(trimmed_cut(ms * 1e6, 0), F.lit("ns")))
        .when(ms < 1, F.concat(trimmed_cut(ms * 1e3), F.lit("µs")))
        .when(ms < 1e3, F.concat(trimmed_cut(ms), F.lit("ms")))
        .when(ms < 60e3, seconds)
        .otherwise(long)
    )


def human_percent(share: Column) -> Column:
    """A share as a percentage with two decimals, cut off."""
    return F.concat(F.format_string("%.2f", F.floor(share.cast("double") * 1e4) / 100.0), F.lit("%"))


def text_width(text: Column) -> Column:
    """Characters shown of a text: escape sequences of terminals are not."""
    return F.char_length(F.regexp_replace(text, "\\x1b(\\[[^\\x40-\\x7e]*[\\x40-\\x7e]|[\\x40-\\x5a\\x5c-\\x5f])", ""))


def same_ascii(a: Column, b: Column) -> Column:
    """Whether two texts are equal but for the case of A-Z; other letters are compared as they are."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(a, upper, lower) == F.translate(b, upper, lower)


def route(request: Column) -> Column:
    """``score``, ``ready`` or ``other`` by the start of a request's first line."""
    return F.when(F.startswith(request, F.lit("POST /fraud-score")), "score").when(F.startswith(request, F.lit("GET /ready")), "ready").otherwise("other")


def percent_floor(part: Column, whole: Column, digits: int = 2) -> Column:
    """A share in percent, rounded down so that 100 % means all."""
    return F.floor(F.try_divide(part.cast("double") * (100 * 10**digits), whole.cast("double"))) / float(10**digits)


def list_setting(text: Column) -> Column:
    """The trimmed, non-empty items of a comma-separated setting."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def int_setting(text: Column, default: int) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(default))
