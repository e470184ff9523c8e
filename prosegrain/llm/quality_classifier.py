"""Quality classifier by Bradley-Terry pairwise ranking.

A document's score is linear in features of its whole text. The weights are learned from preference pairs, a good document over
a bad one, by logistic loss on the difference of their features, so no class balance enters. All labelled documents outside the held out
fold are learned from: they are dealt out to groups, in which each good one meets each bad one. The threshold is the quantile
of all their scores below which as many lie as are labelled bad; a logistic curve through it makes scores of 0 to 1.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegrain.llm.common import Batches, bound_batches, column, cut, rows_of
from prosegrain.llm.labelled import held_out, known_labels

FOLDS, FOLD = 5, 0
#: Documents of the commoner label in a group, about, and of the rarer label at least, about: where it is rarer still, its documents are in several groups.
GROUP, LEAST = 1024, 64
#: Bins of a step towards the threshold, and scores near it that the driver gets at most, but for the last step.
BINS, NEAR = 1024, 10_000
GROUPS = {"symbols": b"#*$%&|<>", "shouts": b"!?", "upper": bytes(range(65, 91)), "digits": b"0123456789", "stops": b".,;:", "marks": b"@/\\=_{}[]\"'()"}
FEATURES = ("log_words", "mean_word", *GROUPS, "dup_lines", "distinct_words", "echoes", "repeats", "line_words")


def features(text: str | None) -> list[float]:
    """Numbers of a whole text: shares of characters, of words and of lines. An empty text has zeros."""
    data = (text or "").encode()
    ws = data.split()
    n = len(ws)
    if not n:
        return [0.0] * len(FEATURES)
    chars = sum(map(len, ws))
    lines = [x for x in data.split(b"\n") if x.strip()]
    runs = set(zip(ws, ws[1:], ws[2:]))
    return [
        math.log1p(n),
        chars / n,
        *((len(data) - len(data.translate(None, group))) / chars for group in GROUPS.values()),
        1 - len(set(lines)) / len(lines),
        len(set(ws)) / n,
        sum(map(operator.eq, ws, ws[1:])) / n,
        1 - len(runs) / max(1, n - 2),
        math.log1p(n / len(lines)),
    ]


def expand(x: np.ndarray) -> np.ndarray:
    """Features, and a saturating form of the shares, which are mostly near zero; kept within 8 deviations by the model."""
    return np.hstack([x, np.sqrt(np.clip(x, 0, None)), np.tanh(10 * x[:, 2:])])


#: Calls a function of features, labels and whether a row is here for the first time for each group, and has what it returns in the groups' order.
Each = Callable[[Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]], list[np.ndarray]]


def pair_sums(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number of pairs of a good and a bad row, and gradient and second derivatives of their logistic loss."""
    good, bad = z[y == 1], z[y == 0]
    p = 1 / (1 + np.exp(np.clip((good @ w)[:, None] - bad @ w, -35, 35)))
    g = bad.T @ p.sum(axis=0) - good.T @ p.sum(axis=1)
    p *= 1 - p
    both = good.T @ p @ bad
    h = (good.T * p.sum(axis=1)) @ good + (bad.T * p.sum(axis=0)) @ bad - both - both.T
    return np.concatenate([[p.size], g, h.ravel()])


def lowest(scores: Callable[[Callable[[np.ndarray], np.ndarray]], list[np.ndarray]], rank: int, low: float, high: float) -> tuple[float, float]:
    """The score at a rank (from 0) and the next one, of scores dealt out to groups, by narrowing the range that it is in. Where no next one is, the same."""
    steps: list[tuple[float, float, int]] = []
    below = 0

    def bins(s: np.ndarray, low: float, high: float) -> np.ndarray:
        return np.minimum((s - low) / (high - low) * BINS, BINS - 1).astype(np.int64)

    def inside(s: np.ndarray) -> np.ndarray:
        for lo, hi, k in steps:
            s = s[bins(s, lo, hi) == k]
        return s

    while high > low:
        n = sum(scores(lambda s: np.bincount(bins(inside(s), low, high), minlength=BINS).astype(float)))
        k = int(np.searchsorted(np.cumsum(n), rank - below, side="right"))
        below += int(n[:k].sum())
        steps.append((low, high, k))
        if n[k] <= NEAR:
            break
        ends = np.array(scores(lambda s: np.array([(x := inside(s)).min(initial=math.inf), x.max(initial=-math.inf)])))
        low, high = float(ends[:, 0].min()), float(ends[:, 1].max())
    if high > low:
        at = float(np.sort(np.concatenate(scores(inside)))[rank - below])
    else:
        at = low
    upto, after = (np.array(x) for x in zip(*scores(lambda s: np.array([np.sum(s <= at), s[s > at].min(initial=math.inf)]))))
    return at, at if upto.sum() > rank + 1 or np.isinf(after.min()) else float(after.min())


class Ranking:
    """Weights, threshold and curve."""

    def __init__(self, x: np.ndarray, y: np.ndarray, threshold: float):
        self.learn(lambda f: [f(x, y, np.ones(len(y), dtype=bool))], int(np.sum(y == 1)), int(np.sum(y == 0)), threshold)

    @classmethod
    def of_groups(cls, each: Each, good: int, bad: int, threshold: float) -> Ranking:
        """The model of so many good and bad rows, which each() has."""
        self = cls.__new__(cls)
        self.learn(each, good, bad, threshold)
        return self

    def learn(self, each: Each, good: int, bad: int, threshold: float) -> None:
        n = good + bad
        self.slope, self.share = 0.0, (good + 0.5) / (n + 1)
        if not good or not bad:
            return
        self.mean = sum(each(lambda x, y, first: expand(x[first]).sum(axis=0))) / n
        mean = self.mean
        self.scale = np.sqrt(sum(each(lambda x, y, first: ((expand(x[first]) - mean) ** 2).sum(axis=0))) / n) + 1e-6
        self.w = np.zeros(len(self.mean))
        self.fit(each)

        def scores(f):
            return each(lambda x, y, first: f(self.raw(x[first])))

        low, high = (np.array(x) for x in zip(*scores(lambda s: np.array([s.min(initial=math.inf), s.max(initial=-math.inf)]))))
        at, after = lowest(scores, bad - 1, float(low.min()), float(high.max()))
        self.cut = at + (1 - bad / n) * (after - at)
        self.offset = math.log(threshold / (1 - threshold))
        middle = sum(scores(lambda s: np.array([s.sum()])))[0] / n
        spread = math.sqrt(sum(scores(lambda s: np.array([((s - middle) ** 2).sum()])))[0] / n) or 1.0
        slopes = np.geomspace(0.05, 20, 40) / spread

        def losses(x: np.ndarray, y: np.ndarray, first: np.ndarray) -> np.ndarray:
            s, sign = self.raw(x[first]) - self.cut, np.where(y[first] == 1, -1, 1)
            return np.array([np.logaddexp(0, sign * (a * s + self.offset)).sum() for a in slopes])

        self.slope = float(slopes[np.argmin(sum(each(losses)))])

    def fit(self, each: Each, rounds: int = 25, keep: float = 1e-3) -> None:
        """Logistic loss of the pairs of all groups by Newton steps; keep pulls the weights to zero."""
        k = len(self.w)
        for _ in range(rounds):
            got = sum(each(lambda x, y, first: pair_sums(self.standard(expand(x)), y, self.w)))
            n = max(1.0, got[0])
            step = np.linalg.solve(got[1 + k :].reshape(k, k) / n + keep * np.eye(k), got[1 : 1 + k] / n + keep * self.w)
            self.w = self.w - step
            if np.abs(step).max() < 1e-6:
                break

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.standard(expand(x)) @ self.w

    def standard(self, z: np.ndarray) -> np.ndarray:
        return np.clip((z - self.mean) / self.scale, -8, 8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.slope:
            return np.full(len(x), self.share)
        s = self.raw(x)
        return 1 / (1 + np.exp(-np.clip(self.slope * (s - self.cut) + self.offset, -35, 35)))


def numbers(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def dealt(rows: DataFrame, good: int, bad: int) -> DataFrame:
    """its_group and rows, an array of (label, first, x): the rows (doc_id, label, x) dealt out to groups by their hashes."""
    groups = -(-max(good, bad) // GROUP)
    copies = min(groups, -(-LEAST * groups // min(good, bad)))
    rare = F.col("label") == (1 if good < bad else 0)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(rare, copies - 1).otherwise(0))))
    place = F.pmod(F.pmod(F.xxhash64("doc_id", "x"), F.lit(groups)) + F.col("copy") * (groups // copies), F.lit(groups))
    # in an order of its own, so that sums do not depend on how tasks ended
    return rows.groupBy(place.alias("its_group")).agg(F.sort_array(F.collect_list(F.struct("label", (F.col("copy") == 0).alias("first"), "x"))).alias("rows"))


def learn(measured: DataFrame, labels: DataFrame, threshold: float) -> Ranking | None:
    """The model of all labelled rows of measured (doc_id, x) outside the held out fold; the driver gets sums of each group only. None without any label."""
    rows = cut(measured.join(known_labels(labels, "quality", FOLDS, FOLD), "doc_id").select("doc_id", "label", "x"), "labelled")
    good, bad = rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if not good or not bad:
        return Ranking.of_groups(lambda f: [], good, bad, threshold) if good or bad else None
    groups = cut(dealt(rows.where("label in (0, 1)"), good, bad), "label-groups")

    def each(f: Callable) -> list[np.ndarray]:
        def run(batches: Batches) -> Batches:
            for batch in batches:
                for k in range(batch.num_rows):
                    label, first, x = batch.column(1)[k].values.flatten()
                    got = f(numbers(x), label.to_numpy(zero_copy_only=False), first.to_numpy(zero_copy_only=False))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([got], pa.list_(pa.float64()))], names=["its_group", "got"])

        return [np.array(r["got"], dtype=float) for r in sorted(groups.mapInArrow(run, "its_group bigint, got array<double>").collect())]

    return Ranking.of_groups(each, good, bad, threshold)


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, score, predicted.

    labels (doc_id, quality) of the fold that is held out are not read into the model, which learns from all others. Whole texts, however long,
    are measured in one narrow pass, written as a few numbers each, and learned from and scored by these.
    Null and empty texts have zero features; with labels of one kind alone all scores are that kind's share, without
    labels one half; null doc_ids are not held out; repeated rows are rows of their own; other columns are not read.
    """
    bound_batches(docs.sparkSession)

    def measure(batches: Batches) -> Batches:
        for batch in batches:
            yield rows_of(batch, ["doc_id"], x=pa.array([features(t) for t in column(batch, "text")], pa.list_(pa.float64())))

    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = cut(docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {kind}, x array<double>"), "measured")
    model = learn(measured, labels, threshold)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            x = numbers(batch.column(1))
            s = model.scores(x) if model else np.full(len(x), 0.5)
            yield rows_of(batch, ["doc_id"], score=pa.array(s, pa.float64()))

    scored = measured.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
