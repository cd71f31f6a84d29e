"""Quality classifier by positive-unlabelled learning (non-negative unbiased risk).

Trusted positives (label 1) and unlabelled web text (all learnable rows; a label 0 is never read)
train a logistic model on staircase features of whole texts. The class prior is estimated from the
same two: a classifier that tells positives from unlabelled rows orders them, and no prior can be
over P(unlabelled above a cut) / P(positives above it); the cut is where that and its sampling error
are least. The risk ``pi*R_p(+) + max(0, R_u(-) - pi*R_p(-))`` is minimised by full-batch steps that
go back up when the inner part turns negative: first on a bounded sample, then, from there, with
sums over all positives and all unlabelled rows.

Defined results: null and empty texts have features of zero and still get a score. With no trusted
positive, or no row to learn from, every score is 0.5. An id with several labels counts as 1 if one
of them is 1. Repeated rows score alike; rows whose id is null are scored but never learned from;
long texts are read whole; extra columns do not matter.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import dropped, remainder, small_batches, stored, text_bytes, widened, without

#: Byte classes counted in a text.
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".?",
    "comma": b",;:",
    "bang": b"!",
    "bar": b"|",
    "sign": b"#$%&*+=<>@^~_\\/",
    "bracket": b"()[]{}\"'",
    "line": b"\n",
    "high": bytes(range(128, 256)),
}
NAMES = (*CLASSES, "log_words", "word_length", "same_as_before", "distinct", "line_copies")


def _class_table() -> np.ndarray:
    out = np.zeros((256, len(CLASSES)))
    for j, members in enumerate(CLASSES.values()):
        out[list(members), j] = 1
    return out


def features(column: pa.Array) -> np.ndarray:
    """One row of len(NAMES) numbers for each text, from all of its bytes."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    counts = np.zeros((n, 256))
    rest = np.zeros((n, len(NAMES) - len(CLASSES)))
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if a == b:
            continue
        counts[i] = np.bincount(data[a:b], minlength=256)
        text = data[a:b].tobytes().lower()
        words = text.split()
        m = max(1, len(words))
        lines = text.split(b"\n")
        rest[i] = (
            math.log1p(len(words)),
            (b - a) / m,
            sum(map(operator.eq, words, words[1:])) / m,
            len(set(words)) / m**0.9,
            1 - len(set(lines)) / len(lines),
        )
    return np.hstack([counts @ _class_table() / np.maximum(np.diff(offsets), 1)[:, None], rest])


@dataclass(frozen=True)
class Model:
    cuts: np.ndarray  # (features, bins - 1): quantiles of each feature among the unlabelled
    weights: np.ndarray  # one for each bin of each feature, and the bias
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_binned(x, self.cuts) @ self.weights, -30, 30)))


def _binned(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A one for each cut a feature reaches: a monotone staircase is then a sum of weights."""
    return np.column_stack([*(x[:, [j]] > cuts[j][None, :] for j in range(x.shape[1])), np.ones(len(x))]).astype(np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def cuts_of(unlabelled: np.ndarray) -> np.ndarray:
    quantiles = np.linspace(0, 1, 14)[1:-1]
    cuts = np.array([np.quantile(unlabelled[:, j], quantiles) for j in range(unlabelled.shape[1])])
    # Rare values lie beyond the quantiles; even cuts of the range see them.
    spread = np.array([np.linspace(unlabelled[:, j].min(), unlabelled[:, j].max(), 10)[1:-1] for j in range(unlabelled.shape[1])])
    return np.sort(np.hstack([cuts, spread]), axis=1)


class _Adam:
    def __init__(self, w: np.ndarray, rate: float, decay: float = 1e-4):
        self.w, self.rate, self.decay, self.t = w, rate, decay, 0
        self.m = self.v = np.zeros_like(w)

    def step(self, g: np.ndarray) -> None:
        self.t += 1
        g = g + self.decay * np.append(self.w[:-1], 0)
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        self.w = self.w - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def _gradient(prior: float, p: tuple[np.ndarray, np.ndarray, float], u: tuple[np.ndarray, float]) -> np.ndarray:
    """Of the non-negative risk, from means over positives (of x*s, x and the loss as negatives) and unlabelled rows (of x*s and that loss)."""
    (px, x, p_loss), (ux, u_loss) = p, u
    up, down = prior * (px - x), ux - prior * px
    return up + down if u_loss - prior * p_loss >= 0 else -down


def separate(positive: np.ndarray, unlabelled: np.ndarray, cuts: np.ndarray, *, steps: int = 60, rate: float = 0.05) -> np.ndarray:
    """Weights that tell positives from unlabelled rows (both count as much)."""
    p, u = _binned(positive, cuts), _binned(unlabelled, cuts)
    adam = _Adam(np.zeros(p.shape[1], np.float32), rate)
    for _ in range(steps):
        adam.step(u.T @ _sigmoid(u @ adam.w) / len(u) + p.T @ (_sigmoid(p @ adam.w) - 1) / len(p))
    return adam.w


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 250, rate: float = 0.05) -> Model:
    """Minimise the non-negative unbiased risk with the logistic loss (Adam, full batch)."""
    cuts = cuts_of(unlabelled)
    p, u = _binned(positive, cuts), _binned(unlabelled, cuts)
    start = np.zeros(p.shape[1], np.float32)
    start[-1] = np.log(prior / (1 - prior))
    adam = _Adam(start, rate)
    loss = lambda z: float(np.logaddexp(0, np.clip(z, -30, 30)).mean())
    for _ in range(steps):
        zp, zu = p @ adam.w, u @ adam.w
        adam.step(_gradient(prior, (p.T @ _sigmoid(zp) / len(p), p.mean(axis=0), loss(zp)), (u.T @ _sigmoid(zu) / len(u), loss(zu))))
    return Model(cuts, adam.w.astype(np.float32), prior)


def prior_of(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """The class prior, from histograms of a score over positives and unlabelled rows."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    above = lambda h: np.cumsum(h[::-1])[::-1] / h.sum()
    q_p, q_u = above(positive), above(unlabelled)
    error = np.sqrt(np.log(4 / delta) / 2 / n_u) + np.sqrt(np.log(4 / delta) / 2 / n_p)
    seen = q_p > 0
    bound = (q_u[seen] + error) / q_p[seen]
    return float(np.clip((q_u[seen] / q_p[seen])[np.argmin(bound)], 0.01, 0.99))


#: Bins of the score from which the prior is read.
BINS = 512
SIDES = 3


def _codes(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many cuts each feature reaches: a row of bytes."""
    return np.column_stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(x.shape[1])]).astype(np.uint8)


class _Sums:
    """Sums over all rows of a table of codes (side, code): one job for each call. Side 0 is unlabelled,
    1 and 2 are the positives that did and did not help to order them."""

    def __init__(self, coded: DataFrame, cuts: np.ndarray):
        self.coded, self.shape = coded, cuts.shape

    def _table(self, w: np.ndarray) -> np.ndarray:
        steps = w[:-1].reshape(self.shape)
        return np.hstack([np.zeros((len(steps), 1)), np.cumsum(steps, axis=1)])

    def _run(self, w: np.ndarray, width: int, add: Callable) -> np.ndarray:
        table, bias, n = self._table(w), float(w[-1]), self.shape[0]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((SIDES, width))
            for batch in batches:
                if batch.num_rows:
                    codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, n)
                    own = batch.column(0).to_numpy()
                    z = np.clip(table[np.arange(n), codes].sum(axis=1) + bias, -30, 30)
                    for side in range(SIDES):
                        total[side] += add(codes[own == side], z[own == side])
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.list_(pa.float64())), pa.array(range(SIDES), pa.int32())], ["x", "side"])

        sums = self.coded.mapInArrow(work, "x array<double>, side int").select("side", F.posexplode("x").alias("i", "v"))
        found = sums.groupBy("side", "i").agg(F.sum("v").alias("v")).toPandas()  # SIDES * width rows
        out = np.zeros((SIDES, width))
        out[found["side"], found["i"]] = found["v"]
        return out

    def histogram(self, w: np.ndarray) -> np.ndarray:
        """Scores of each side's rows, by bin."""
        return self._run(w, BINS, lambda codes, z: np.bincount(np.minimum((_sigmoid(z) * BINS).astype(np.int64), BINS - 1), minlength=BINS))

    def risk(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For unlabelled rows and positives: means of the features times the score, of the features, and the loss."""
        n, k = self.shape

        def add(codes: np.ndarray, z: np.ndarray) -> np.ndarray:
            s = _sigmoid(z)
            reach = lambda weight: np.concatenate([np.cumsum(np.bincount(codes[:, j], weight, k + 1)[::-1])[::-1][1:] for j in range(n)])
            ones = np.ones(len(z))
            return np.concatenate([reach(s), [s.sum()], reach(ones), [len(z)], [np.logaddexp(0, z).sum()]])

        sums = self._run(w, 2 * (n * k + 1) + 1, add)
        sums = np.array([sums[0], sums[1] + sums[2]])
        return sums / sums[:, [-2]]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, sample: int = 6_000, steps: int = 8, text: str = "text", doc_id: str = "doc_id") -> Model:
    """Fit on rows for which ``learn`` holds. A sample (``sample`` positives, ``sample`` unlabelled rows,
    drawn by a hash of the id) sets where the staircases step and where the weights start; the prior
    and ``steps`` steps of the risk come from all rows. No texts reach the driver.
    """
    marks = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_quality"))
    marks = marks.where(learn_on("_id") & (F.col("_quality") == 1)).select("_id")
    ones = marks.count()
    rows = docs.where(learn).select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    n = rows.count()
    unknown = Model(np.zeros((len(NAMES), 0)), np.zeros(1, np.float32), 0.5)
    if not ones or not n:
        return unknown
    draw = lambda key, size: F.pmod(F.xxhash64(F.lit(key), F.col("_id")), F.lit(1 << 30)) < int(min(1.0, sample / size) * (1 << 30))
    half = (F.pmod(F.xxhash64(F.lit("half"), F.col("_id")), F.lit(2)) + 1).cast("int").alias("_side")
    picked = marks.where(draw("positive", ones)).select("_id", half)
    chosen = rows.where(draw("unlabelled", n)).select("_text", F.lit(0).alias("_side"))
    trusted = rows.join(picked, "_id").select("_text", "_side")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text", 2 << 20):
            x = features(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["side", "x"])

    found = chosen.unionByName(trusted).mapInArrow(work, "side int, x array<double>").toPandas()
    x, side = np.array(found["x"].tolist()).reshape(-1, len(NAMES)), found["side"].to_numpy(np.int64)
    order = np.lexsort((*x.T, side))
    x, side = x[order], side[order]
    unlabelled, positive, helping = x[side == 0], x[side > 0], x[side == 1]
    if not len(unlabelled) or not len(positive):
        return unknown
    cuts = cuts_of(unlabelled)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text", 2 << 20):
            codes = _codes(features(batch.column(1)), cuts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["_id", "code"])

    kind = rows.schema["_id"].dataType.simpleString()
    coded = stored(rows.mapInArrow(code, f"_id {kind}, code binary"))  # len(NAMES) bytes a row
    both = stored(coded.select(F.lit(0).alias("side"), "code").unionByName(coded.join(marks.select("_id", half), "_id").select(F.col("_side").alias("side"), "code")))
    sums = _Sums(both, cuts)
    scores = sums.histogram(separate(helping if len(helping) else positive, unlabelled, cuts))
    prior = prior_of(scores[2] if scores[2].any() else scores[1], scores[0])
    adam = _Adam(train(positive, unlabelled, prior).weights.astype(np.float64), 0.01)
    width = cuts.size + 1
    for _ in range(steps):
        u, p = sums.risk(adam.w)
        adam.step(_gradient(prior, (p[:width], p[width : 2 * width], p[-1]), (u[:width], u[-1])))
    dropped(both)
    dropped(coded)
    return Model(cuts, adam.w.astype(np.float32), prior)


def learn_on(doc_id: str) -> Column:
    return F.col(doc_id).isNotNull() & (remainder(doc_id, 4) != 2)


def score(docs: DataFrame, model: Model, *, text: str = "text", into: str = "quality_score") -> DataFrame:
    """Every row of ``docs`` with its score in ``into`` (which replaces a column of that name)."""
    data = without(docs, into)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # under 100 kB

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text, 2 << 20):
            value = shared.value.score(features(batch.column(batch.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, pa.float64())], [*batch.schema.names, into])

    return data.mapInArrow(work, widened(data.schema, **{into: "double"}))
