"""Quality classifier by positive-unlabelled learning (operator 3).

Every whole text becomes one row of features, written once: rates of characters,
shares of repeats, shapes of words and lines, and shares of words and of word pairs
by hash. The model is linear in them and minimises the non-negative unbiased risk
(Kiryo et al. 2017)

    prior * E_p[loss(g)] + max(0, E_u[loss(-g)] - prior * E_p[loss(-g)])

with the logistic loss, so the sigmoid of ``g`` estimates the chance of label 1.
The expectation over unlabelled rows covers all rows that aren't held out (labels
are never looked at); it, its gradient and its curvature are sums that tasks make
of their rows. Trusted positives (label 1, not held out) are a sample of about
``SAMPLE`` rows on the driver, by a hash of the id alone. For a logistic loss the
risk is the larger of two convex functions, so it has one minimum: the minimum of
``prior * E_p[loss(g)] + part * (E_u[loss(-g)] - prior * E_p[loss(-g)])`` with
part 1, or, if the bracket is negative there, with the part between 0 and 1 that
makes it 0 (part 0 if it is negative even there). Newton steps find each, bisection
the part.

The class prior is estimated first (best-bin estimate, Garg et al. 2021): a
discriminator of positives against unlabelled rows orders both, and the smallest
ratio of their upper tails is the share of positives.

Scoring covers all rows. Null and empty texts have all-zero features and are scored
like any other. Repeated rows score alike. Without positives there is nothing to
learn from: all scores are 0.5. Label rows with a null id or null quality are
ignored. Columns of the input named like features or scores are never read; other
columns pass through ``keep_quality`` unchanged. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm._store import materialise, numbered, release, ship, small_side

#: Labelled rows (trusted positives) that the fit uses, about.
SAMPLE = 20_000
#: Share of label folds that is never learned from: crc32(doc_id) mod 5 = 0.
FOLDS = 5
THRESHOLD = 0.3
#: Marks that are counted together: stops, pauses, calls, quotes and brackets, joints, symbols.
MARKS = (".,", ";:", "!?", "\"'()[]{}`", "-/_@=+", "#*$%&|<>~^\\")
#: Hash buckets of words and of word pairs, and the words whose hashes a task remembers.
BUCKETS, KEEP_WORDS = 32, 150_000
#: Ridge on the weights (hashed features are many and each says little), Newton steps of a fit at most, and bisections.
DECAY, HASHED_DECAY, STEPS, BISECTIONS = 1e-3, 0.1, 25, 14
#: Rows of partial sums that reach the driver at once, at most.
SLOTS = 16
#: Features are scaled by their deviation, but no rare one by less than this, and clipped.
LEAST_SCALE, CLIP = 0.05, 4.0


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KEEP_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


_WORDS = _Words()


def _hashed(words: list[str]) -> np.ndarray:
    """Roots of the shares of words, and of word pairs, by hash bucket."""
    if not words:
        return np.zeros(2 * BUCKETS)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    ones = np.bincount((h % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS) / len(h)
    twos = np.bincount((pairs % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS) / max(1, len(pairs))
    return np.sqrt(np.concatenate([ones, twos]))


def features(text: str | None) -> np.ndarray:
    """The feature row of one whole text."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(data))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    marks = [np.sqrt(min(counts[list(group.encode())].sum() / n, 4.0)) for group in MARKS]
    triples = list(zip(words, words[1:], words[2:], strict=False))
    upper = counts[65:91].sum()
    letters = max(1, upper + counts[97:123].sum() + counts[128:].sum())
    shape = [
        np.log1p(len(data)) / 10,
        np.log1p(len(words)) / 8,
        min(len(data) / n, 30.0) / 10,
        upper / letters,
        counts[48:58].sum() / m,
        counts[128:].sum() / m,
        counts[:32].sum() / m,
        1 - len(set(words)) / n if words else 0.0,
        1 - len(set(triples)) / len(triples) if triples else 0.0,
        sum(a == b for a, b in pairwise(words)) / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        min(len(words) / max(1, len(lines)), 200.0) / 50,
        sum(w.isupper() for w in words) / n,
        sum(w.isalpha() for w in words) / n,
        sum(not any(map(str.isalnum, w)) for w in words) / n,
        float(not words),
    ]
    return np.concatenate([marks, shape, _hashed(words)]).astype(np.float32)


PLAIN = len(MARKS) + 16
WIDTH = PLAIN + 2 * BUCKETS


def feature_table(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and ``features``; other columns of ``docs`` are never read."""
    ship(docs.sparkSession)
    schema = docs.select(*keys).schema.add("features", T.ArrayType(T.FloatType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                rows = np.concatenate([features(t) for t in some.column(len(keys)).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(some.num_rows + 1) * WIDTH, pa.int32()), pa.array(rows))
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in range(len(keys))), lists], names=schema.names)
        _WORDS.clear()
        release()

    return docs.select(*keys, F.col(text).alias("__text")).mapInArrow(run, schema)


class Model:
    """A linear function of standardised, clipped features."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float):
        self.centre, self.scale, self.weights, self.prior = centre, scale, weights, prior

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -CLIP, CLIP)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x.astype(np.float64)) @ self.weights, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _decay(size: int) -> np.ndarray:
    return np.concatenate([np.full(min(size, PLAIN), DECAY), np.full(max(0, size - PLAIN), HASHED_DECAY), [DECAY]])


#: Of weights: mean loss, gradient and curvature over a set of rows.
Parts = Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]]


def newton(parts: Parts, size: int, start: np.ndarray | None = None) -> np.ndarray:
    """The minimum of a convex mean loss with ridge, by Newton steps that are halved where they climb."""
    decay = _decay(size)
    w = np.zeros(size + 1) if start is None else start
    value, gradient, curvature = parts(w)
    value += (decay * w * w).sum() / 2
    for _ in range(STEPS):
        step = np.linalg.solve(curvature + np.diag(decay), gradient + decay * w)
        length = 1.0
        while True:
            tried = w - length * step
            found, of_tried, curve = parts(tried)
            found += (decay * tried * tried).sum() / 2
            if found <= value + 1e-12 or length < 1e-4:
                break
            length /= 2
        gain, w, value, gradient, curvature = value - found, tried, found, of_tried, curve
        if gain < 1e-9:
            break
    return w


def logistic(z: np.ndarray, sign: int) -> Parts:
    """Mean of log(1 + exp(-sign * z w)) over the rows of a design matrix."""

    def parts(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        g = sign * (z @ w)
        s = _sigmoid(-g)
        return float(np.logaddexp(0, -g).mean()), -sign * (z.T @ s) / len(z), (z * (s * (1 - s))[:, None]).T @ z / len(z)

    return parts


def prior_from_tails(upper_p: np.ndarray, upper_u: np.ndarray, n_p: int, n_u: int) -> float:
    """Share of positives among the unlabelled, from the shares of either above common thresholds."""
    slack = np.sqrt(np.log(40) / 2 / n_p) + np.sqrt(np.log(40) / 2 / n_u)
    best = np.argmin((upper_u + slack) / upper_p)
    return float(np.clip(upper_u[best] / upper_p[best], 0.01, 0.99))


def thresholds(positive: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(positive, np.linspace(0, 0.9, 181)))


def above(scores: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """How many scores reach each threshold."""
    return len(scores) - np.searchsorted(np.sort(scores), grid)


def minimise_risk(dp: np.ndarray, unlabelled: Parts, prior: float) -> np.ndarray:
    """Weights of least non-negative unbiased risk; ``unlabelled``: parts of E_u[loss(-g)]."""
    right, wrong = logistic(dp, 1), logistic(dp, -1)
    size = dp.shape[1] - 1

    def with_part(part: float) -> Parts:
        def parts(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            (a, ga, ha), (b, gb, hb), (c, gc, hc) = right(w), wrong(w), unlabelled(w)
            return prior * a + part * (c - prior * b), prior * ga + part * (gc - prior * gb), prior * ha + part * (hc - prior * hb)

        return parts

    def negative(w: np.ndarray) -> float:
        return unlabelled(w)[0] - prior * wrong(w)[0]

    w = newton(with_part(1.0), size)
    if negative(w) >= 0:
        return w
    w = newton(with_part(0.0), size)
    if negative(w) <= 0:
        return w
    low, high = 0.0, 1.0
    for _ in range(BISECTIONS):
        part = (low + high) / 2
        w = newton(with_part(part), size, w)
        low, high = (part, high) if negative(w) >= 0 else (low, part)
    return w


def _summed(table: DataFrame, of_rows: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of a vector that tasks compute of their features; tasks' vectors are added up in SLOTS groups before the driver adds these."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            lists = batch.column(1)
            for at in range(0, batch.num_rows, 4096):
                some = lists.slice(at, 4096)
                found = of_rows(np.asarray(some.flatten()).reshape(-1, WIDTH))
                total = found if total is None else total + found
            slot = batch.column(0)[0].as_py() % SLOTS
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["slot", "sums"])

    def added(group: pa.Table) -> pa.Table:
        rows = np.asarray(group["sums"].combine_chunks().flatten()).reshape(group.num_rows, -1)
        return pa.table({"sums": pa.array([rows.sum(axis=0).tolist()], pa.list_(pa.float64()))})

    parts = table.select(F.spark_partition_id(), "features").mapInArrow(partial, "slot int, sums array<double>")
    return np.sum([r.sums for r in parts.groupBy("slot").applyInArrow(added, "sums array<double>").collect()], axis=0)


def fit(positive: np.ndarray, table: DataFrame, prior: float | None = None) -> Model | None:
    """The model from positive rows and a materialised table of unlabelled ``features``; the prior is estimated unless given."""
    p = positive.astype(np.float64)
    moments = _summed(table, lambda x: np.concatenate([[len(x)], x.sum(axis=0, dtype=np.float64), (x.astype(np.float64) ** 2).sum(axis=0)]))
    if moments.ndim == 0 or not len(p):
        return None
    n = int(moments[0])
    total, squares = moments[1 : WIDTH + 1] + p.sum(axis=0), moments[WIDTH + 1 :] + (p * p).sum(axis=0)
    deviation = np.sqrt(np.maximum(squares / (n + len(p)) - (total / (n + len(p))) ** 2, 0))
    model = Model(p.mean(axis=0), np.maximum(deviation, LEAST_SCALE), np.zeros(WIDTH + 1), 0.5)
    dp = model.design(p)
    width = WIDTH + 1

    def unlabelled(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def of_rows(x: np.ndarray) -> np.ndarray:
            z = model.design(x.astype(np.float64))
            g = z @ w
            s = _sigmoid(g)
            return np.concatenate([[np.logaddexp(0, g).sum()], z.T @ s, ((z * (s * (1 - s))[:, None]).T @ z).ravel()])

        sums = _summed(table, of_rows) / n
        return float(sums[0]), sums[1 : width + 1], sums[width + 1 :].reshape(width, width)

    def remembered(f: Parts) -> Parts:
        last: list = [None, None]

        def parts(w: np.ndarray):
            if last[0] is None or not np.array_equal(last[0], w):
                last[:] = [w.copy(), f(w)]
            return last[1]

        return parts

    unlabelled = remembered(unlabelled)
    if prior is None:
        right = logistic(dp, 1)

        def halves(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            (a, ga, ha), (c, gc, hc) = right(w), unlabelled(w)
            return (a + c) / 2, (ga + gc) / 2, (ha + hc) / 2

        apart = newton(halves, WIDTH)
        scores = dp @ apart
        grid = thresholds(scores)
        reach = _summed(table, lambda x: above(model.design(x.astype(np.float64)) @ apart, grid).astype(np.float64))
        prior = prior_from_tails(above(scores, grid) / len(scores), reach / n, len(scores), n)
    model.weights, model.prior = minimise_risk(dp, unlabelled, prior), prior
    return model


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _sampled(rows: DataFrame, key: str, salt: int, total: int, sample: int) -> DataFrame:
    """About ``sample`` of ``total`` rows, by a hash of the key."""
    cut = 1 << 30 if total <= sample else int(sample / total * (1 << 30))
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 30)) < cut)


def _matrix(rows: DataFrame, key: str) -> np.ndarray:
    got = rows.select(key, "features").toArrow().sort_by(key)
    return np.asarray(got["features"].combine_chunks().flatten()).reshape(-1, WIDTH) if got.num_rows else np.empty((0, WIDTH), np.float32)


def train(table: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id") -> Model | None:
    """The model from a materialised feature table and ``labels`` (``key, quality``); None without positives."""
    positives = labels.where((F.col("quality") == 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).select(key).distinct()
    chosen = materialise(_sampled(positives, key, 1, positives.count(), sample), "positives")
    open_rows = table.where(~held_out(F.col(key)))
    p = _matrix(open_rows.join(small_side(chosen), key), key)
    return fit(p, open_rows) if len(p) else None


def _scored(table: DataFrame, model: Model | None) -> DataFrame:
    """The table with ``score`` instead of ``features``, its last column."""
    keys = table.columns[:-1]
    schema = table.select(*keys).schema.add("score", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(len(keys)).flatten()).reshape(-1, WIDTH)
            got = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array(got, pa.float64())], names=schema.names)

    return table.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """``key, held_out, score, predicted`` of every row."""
    table = materialise(feature_table(docs, keys=(key,)), "features")
    scored = _scored(table, train(table, labels, sample, key))
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, columns unchanged.

    Each text is read once; the rows that go are found by their numbers, so whole
    texts are shuffled only where these are too many to broadcast.
    """
    rows = numbered(docs, "__row")
    table = materialise(feature_table(rows, keys=("doc_id", "__row")), "features")
    scored = _scored(table, train(table, labels, sample))
    gone = materialise(scored.where(F.col("score") < threshold).select("__row"), "rejected")
    return rows.join(small_side(gone), "__row", "left_anti").drop("__row")
