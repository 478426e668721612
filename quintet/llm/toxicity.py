"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

One weight for each feature is shared by all thresholds: P(grade <= k) is the
logistic function of threshold k less the score. Features are words and
their first four and five characters, which inflected forms share. The model is fitted
on a bounded sample of labelled rows; every document is scored.

``labels`` only say toxic or not, so nothing in the data grades severity: the grades 1 and 2 are a proxy. They are made by
markers, the words that stand in toxic training rows almost only: toxic rows with as many
distinct ones as the median, or fewer, have grade 1, others 2. The first threshold, which ``toxic`` and ``drop_toxic``
go by, rests on the labels alone; the second orders documents by how much of the vocabulary of toxic rows they have. Both are held against labelled
rows that were not trained on (``held_out``).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quintet.llm.common import materialize, by_bytes

#: Labelled rows that the model is fitted on at most, those with the least hash of their id.
TRAIN_ROWS = 12_000
#: Features of the model at most, those with the highest chi-square.
MODEL_FEATURES = 20_000
LEAST_ROWS, LEAST_CHI2 = 4, 15.0
MARKER_SHARE = 0.9
PREFIXES = (4, 5)
GRADES = 3

_LETTER = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
KEPT_WORDS = 300_000


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and all characters beyond ASCII, as UTF-8."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_LETTER).split() if text else []


def features_of(word: bytes) -> list[str]:
    w = word.decode("utf-8", "replace")
    return [w, *(f"{w[:k]}*" for k in PREFIXES if len(w) >= k)]


def features(text: str | None) -> dict[str, float]:
    """Each feature's value: 1 + the logarithm of its count."""
    count: Counter[str] = Counter()
    for w, n in Counter(words(text)).items():
        for f in features_of(w):
            count[f] += n
    return {f: 1.0 + math.log(n) for f, n in count.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class OrdinalModel:
    """Weights by feature, and rising thresholds between the grades."""

    def __init__(self, weights: dict[str, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, np.asarray(thresholds, float)
        self._known: dict[bytes, list[str]] = {}

    def score(self, text: str | None) -> float:
        known, count = self._known, Counter()
        if len(known) > KEPT_WORDS:
            known.clear()
        ws = words(text)
        hit = False
        for w in set(ws):
            f = known.get(w)
            if f is None:
                f = known[w] = [x for x in features_of(w) if x in self.weights]
            hit = hit or bool(f)
        if not hit:
            return 0.0
        for w, n in Counter(ws).items():
            for x in known[w]:
                count[x] += n
        return sum(self.weights[x] * (1.0 + math.log(n)) for x, n in count.items())

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. of each score."""
        return _sigmoid(np.asarray(scores, float)[:, None] - self.thresholds[None, :])

    @classmethod
    def fit(cls, rows: list[dict[str, float]], grades: list[int], n_grades: int = GRADES, l2: float = 1e-4, steps: int = 400, rate: float = 0.05) -> OrdinalModel:
        """Penalised maximum likelihood by full-batch Adam; deterministic."""
        names = {f: k for k, f in enumerate(sorted({f for r in rows for f in r}))}
        y = np.array(grades, np.int64)
        share = np.clip([(y >= k).mean() if len(y) else 0.0 for k in range(1, n_grades)], 1e-4, 1 - 1e-4)
        start = -np.log(share / (1 - share))
        if len(y) == 0 or y.min() == y.max() or not names:
            return cls({}, np.maximum.accumulate(start + 1e-6 * np.arange(len(start))))
        of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        col = np.array([names[f] for r in rows for f in r], np.int64)
        val = np.array([v for r in rows for v in r.values()])
        n, m = len(y), n_grades - 1
        p = np.concatenate((np.zeros(len(names)), start[:1], np.log(np.maximum(np.diff(start), 0.1))))
        first, second = np.zeros_like(p), np.zeros_like(p)
        for t in range(1, steps + 1):
            w, gaps = p[: len(names)], np.exp(p[len(names) + 1 :])
            edges = np.concatenate(([-np.inf], p[len(names)] + np.concatenate(([0.0], np.cumsum(gaps))), [np.inf]))
            eta = np.bincount(of, val * w[col], n)
            upper, lower = _sigmoid(edges[y + 1] - eta), _sigmoid(edges[y] - eta)
            upper, lower = np.where(y == m, 1.0, upper), np.where(y == 0, 0.0, lower)
            prob = np.maximum(upper - lower, 1e-12)
            slope = upper + lower - 1.0  # of the log likelihood by eta
            by_edge = np.bincount(y[y < m], (upper * (1 - upper) / prob)[y < m], m) - np.bincount(y[y > 0] - 1, (lower * (1 - lower) / prob)[y > 0], m)
            after = np.cumsum(by_edge[::-1])[::-1]
            g = -np.concatenate((np.bincount(col, val * slope[of], len(names)) / n, after[:1] / n, after[1:] * gaps / n))
            g[: len(names)] += l2 * w
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            p -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        return cls({f: float(p[k]) for f, k in names.items()}, p[len(names)] + np.concatenate(([0.0], np.cumsum(np.exp(p[len(names) + 1 :])))))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, model_features: int = MODEL_FEATURES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> OrdinalModel:
    """Fit on at most ``train_rows`` labelled documents; what comes to the driver is bounded by the two limits.

    Rows without an id, a label or a document are left out of the sample. Labels other than 0 count as toxic, and a
    document that has labels of both kinds does too. Of documents that repeat an id the one of the least text hash, then text,
    is taken; a null text counts as empty. With no labels, or labels of one kind, the model has no weights. So the result is the
    same whatever the order of the rows.
    """
    spark = docs.sparkSession
    sample = labels.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) != 0).cast("int").alias("toxic")).dropna().groupBy("id").agg(F.max("toxic").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("id"), "id").limit(train_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "id")
    texts = texts.groupBy("id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")).select("id", "toxic", F.col("least.text").alias("text"))

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            found = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.float64()))], ["id", "toxic", "names", "vals"])

    bags = materialize(texts.select("id", "text", "toxic").mapInArrow(bag, "id long, toxic int, names array<string>, vals array<double>"), "bags")
    n, toxic = bags.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < n:
        return OrdinalModel.fit([], [])
    counts = bags.select("toxic", F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).where(F.col("n") >= LEAST_ROWS)
    rest = F.col("n") * F.lit(float(n)) - F.col("n") * F.col("n")
    chi2 = (F.col("t") * F.lit(float(n)) - F.col("n") * F.lit(float(toxic))) ** 2 * F.lit(float(n)) / (rest * F.lit(float(toxic)) * F.lit(float(n - toxic)))
    chosen = counts.where(F.col("n") < n).withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "name").limit(model_features).select("name", (F.col("t") >= MARKER_SHARE * F.col("n")).alias("marker"))
    marks = {r["name"]: r["marker"] for r in chosen.collect()}
    sent = spark.sparkContext.broadcast(set(marks))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            kept = [[(f, v) for f, v in zip(fs, vs, strict=True) if f in sent.value] for fs, vs in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[f for f, _ in k] for k in kept], pa.list_(pa.string())), pa.array([[v for _, v in k] for k in kept], pa.list_(pa.float64()))], ["id", "toxic", "names", "vals"])

    got = sorted(bags.mapInArrow(narrow, bags.schema).collect())
    rows = [dict(zip(r["names"], r["vals"], strict=True)) for r in got]
    load = [sum(marks[f] and not f.endswith("*") or 0 for f in r) for r in rows]
    middle = float(np.median([x for x, r in zip(load, got, strict=True) if r["toxic"]]))
    return OrdinalModel.fit(rows, [0 if not r["toxic"] else 2 if x > middle else 1 for x, r in zip(load, got, strict=True)])


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), probability: bool = False) -> DataFrame:
    """``(doc_id, expected_severity, grade, toxic)`` for every row of ``docs``, and its columns ``keep``.

    expected_severity is the mean of the grade, grade its most likely value, and
    toxic says that grade 1 or more is more likely than 0. A null or empty
    text has no features. Rows are judged one by one, repeated ids and null ids too. An empty table gives an empty one. Other columns are not read. With ``probability``
    there is ``p_toxic``, that of grade 1 or more.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in by_bytes(batches):
            above = m.at_least(np.array([m.score(t) for t in b.column(1).to_pylist()]))
            each = -np.diff(np.concatenate((np.ones((len(above), 1)), above, np.zeros((len(above), 1))), axis=1), axis=1)
            arrays = [pa.array(above.sum(1)), pa.array(each.argmax(1).astype(np.int32) if len(each) else np.zeros(0, np.int32)), pa.array(above[:, 0] > 0.5)]
            more = [pa.array(np.ascontiguousarray(above[:, 0]))] if probability else []
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays, *b.columns[2:], *more], ["doc_id", "expected_severity", "grade", "toxic", *keep, *["p_toxic"] * probability])

    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("body"), *(F.col(c) for c in keep)).mapInArrow(run, "doc_id long, expected_severity double, grade int, toxic boolean" + kinds + ", p_toxic double" * probability)


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all its columns, that the model does not call toxic.

    Rows are judged one by one, so rows that repeat an id are kept or dropped each by its text; null and empty texts have no
    features, and are kept unless most of the training rows were toxic. An empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in by_bytes(batches):
            if b.num_rows:
                yield b.filter(pa.array(m.at_least(np.array([m.score(t) for t in b.column(at).to_pylist()]))[:, 0] <= 0.5))

    return docs.mapInArrow(run, docs.schema)


def held_out(docs: DataFrame, labels: DataFrame, folds: int = 5, **options) -> DataFrame:
    """``(n, toxic, predicted, accuracy, precision, recall, brier)`` of the first threshold on labelled rows that the model was not fitted on.

    One fold in ``folds``, by a hash of the id, is held out. ``toxic`` is its share of toxic rows, ``predicted`` the mean probability that
    the model gives them, ``brier`` the mean squared error of the probability.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") != 0).cast("int").alias("said")).dropna().groupBy("doc_id").agg(F.max("said").alias("said"))
    test = F.pmod(F.xxhash64("doc_id"), F.lit(folds)) == 0
    found = score(docs, train(docs, rows.where(~test).withColumnRenamed("said", "toxic"), **options), probability=True).join(rows.where(test), "doc_id")
    said, toxic = F.col("said") == 1, F.col("toxic")
    right = F.count_if(said & toxic)
    return found.agg(F.count("*").alias("n"), F.avg("said").alias("toxic"), F.avg("p_toxic").alias("predicted"), F.avg((toxic == said).cast("double")).alias("accuracy"), F.try_divide(right, F.count_if(toxic)).alias("precision"), F.try_divide(right, F.count_if(said)).alias("recall"), F.avg((F.col("p_toxic") - F.col("said")) ** 2).alias("brier"))
