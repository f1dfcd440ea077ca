"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated isotonically.

*Statistics.* A whole text becomes a few bounded numbers (sizes, shares of kinds of bytes, repetition of words and lines), stored in 1/4096ths. All
sums over them are sums of whole numbers, so the fitted model does not depend on partitions or on a repeated task.

*Features.* Standardised statistics x give cos(w x + b) for `FEATURES` random w, b: inner products approach a Gaussian kernel of width `WIDTH`.

*Fit.* Each task adds up the normal equations of its labelled rows, one row per feature and fold; Spark adds the tasks' rows. What meets on the driver
has a fixed size: FOLDS x (FEATURES + 2)^2 numbers. A fold's own model comes from the other folds' sums, and the ridge is the one of `RIDGES` with
the least error on the folds left out.

*Calibration.* Labelled rows are scored by the model of the other folds, counted by score in steps of 1 / `STEPS` (outside -1 to 2 in
the outermost step), and the steps pooled until the share of label 1 does not fall; between the pools' centres the score is interpolated.

Defined results: a null or empty text has statistics of 0 and a score like any other; without any label the score is 0.5, with labels of one kind
that label; a label counts for each document row with its doc_id, labels of one doc_id that differ count for none, null labels or ids neither;
a null doc_id is never held out; repeated rows are scored one by one; no other column is read; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yushi.llm.tables import arrow_map, stored, utf8

STATISTICS = [
    "log_bytes", "log_words", "log_lines", "word_bytes", "word_spread", "upper", "digits", "signs", "bars", "stops", "other_marks", "high", "controls",
    "distinct_words", "distinct_lines", "short_words", "signed_words", "line_words", "ended_lines", "entropy",
]
ONE = 4096
FEATURES, WIDTH, SEED = 256, 4.0, 20
FOLDS, RIDGES = 4, (1e-5, 1e-4, 1e-3, 1e-2, 1e-1)
STEPS, LOW, HIGH = 1024, -1, 2
THRESHOLD = 0.3

_SPACES = b" \t\n\x0b\x0c\r"
_PIECE = 1 << 20
_KINDS = np.array([
    [chr(b) in kind for b in range(256)]
    for kind in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&@=+~^", "|<>{}[]\\/_", ".!?", ",;:'\"()-`")
] + [[b >= 128 for b in range(256)], [(b < 32 and b not in _SPACES) or b == 127 for b in range(256)], [b in _SPACES for b in range(256)]], np.int64)
_MARKS = b"#*$%&@=+~^|<>{}[]\\/_"


# -- statistics -----------------------------------------------------------------------------------------------------


def _words(text: bytes):
    """Words of the text, a piece of about a megabyte at a time."""
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + _PIECE)
        while end < n and text[end] not in _SPACES:
            end += 1
        yield text[at:end].split()
        at = end


def statistics(text: bytes | None) -> list[float]:
    """STATISTICS of one text, each between 0 and some tens."""
    if not text:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, digits, signs, bars, stops, marks, high, controls, spaces = (_KINDS @ counts).tolist()
    n, n_words, size, squares, short, signed = len(text), 0, 0, 0, 0, 0
    distinct: set[bytes] = set()
    for words in _words(text):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n_words += len(words)
        size += int(sizes.sum())
        squares += int((sizes * sizes).sum())
        short += int(np.count_nonzero(sizes <= 2))
        signed += sum(w[-1] in _MARKS for w in words)
        distinct.update(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    ended = sum(x.rstrip()[-1] in b".!?" for x in lines)
    some, written, held = max(n_words, 1), max(n - spaces, 1), max(len(lines), 1)
    mean = size / some
    share = counts[counts > 0] / n
    return [
        np.log1p(n), np.log1p(n_words), np.log1p(len(lines)), min(mean, 40.0), min(np.sqrt(max(squares / some - mean * mean, 0.0)), 40.0),
        upper / written, digits / written, signs / written, bars / written, stops / written, marks / written, high / written, controls / written,
        len(distinct) / some, len(set(lines)) / held, short / some, signed / some, np.log1p(n_words / held), ended / held, float(-(share * np.log(share)).sum()),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics of each text in 1/4096ths."""

    def run(b):
        x = np.array([statistics(t) for t in utf8(b.column(1))]).reshape(b.num_rows, len(STATISTICS))
        flat = pa.array(np.rint(x * ONE).astype(np.int64).ravel())
        ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(STATISTICS))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "x"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, x array<long>")


def _crc(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(_crc(doc_id) % 5 == 0, F.lit(False))


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """x, y, fold of the rows to learn from."""
    sure = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q")).filter("doc_id IS NOT NULL AND q IN (0, 1)")
        .filter(~held_out()).groupBy("doc_id").agg(F.min("q").alias("y"), F.max("q").alias("high")).filter("y = high").drop("high")
    )
    fold = (F.floor(_crc("doc_id") / 5) % FOLDS).cast("int").alias("fold")
    return stats.join(sure, "doc_id").select("x", "y", fold)


# -- model ----------------------------------------------------------------------------------------------------------


class Model(NamedTuple):
    """Means and deviations of the statistics, one weight vector per fold and one of all, and the calibration's corners."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    corners: tuple[np.ndarray, np.ndarray]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), len(STATISTICS)) / ONE


def features(x: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """1/4096ths of the constant and of each random feature, as whole numbers in doubles."""
    rng = np.random.default_rng(SEED)
    w = rng.standard_normal((x.shape[1], FEATURES)) / WIDTH
    shift = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.cos(np.clip((x - mean) / deviation, -8, 8) @ w + shift)
    return np.rint(np.concatenate([np.ones((len(x), 1)), z], axis=1) * ONE)


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and standard deviation of each statistic over the labelled rows; a statistic that never changes gets 1."""
    k = len(STATISTICS)
    wide = lambda c: c.cast("decimal(38,0)")
    x = [F.col("x")[i] for i in range(k)]
    row = rows.agg(F.count("*"), *[F.sum(wide(c)) for c in x], *[F.sum(wide(c) * wide(c)) for c in x]).first()
    if not row[0]:
        return None
    n, s, q = int(row[0]), [int(v) for v in row[1:k + 1]], [int(v) for v in row[k + 1:]]
    spread = [max(n * b - a * a, 0) / (n * n) for a, b in zip(s, q)]
    return np.array([a / n / ONE for a in s]), np.array([v ** 0.5 / ONE if v > 0 else 1.0 for v in spread])


def normal_equations(rows: DataFrame, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """For each fold the matrix of inner products of constant, features and label: every task adds up its rows, Spark adds the tasks."""
    size = FEATURES + 2

    def run(batches):
        total = np.zeros((FOLDS, size, size), np.int64)
        for b in batches:
            y, fold = b.column(1).to_numpy(), b.column(2).to_numpy()
            for first in range(0, b.num_rows, 8192):
                at = slice(first, first + 8192)
                z = features(_matrix(b.column(0).slice(first, 8192)), mean, deviation)
                z = np.concatenate([z, y[at, None] * float(ONE)], axis=1)
                for f in range(FOLDS):
                    part = z[fold[at] == f]
                    total[f] += (part.T @ part).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(FOLDS), size).astype(np.int32)), pa.array(np.tile(np.arange(size), FOLDS).astype(np.int32)), pa.array(list(total.reshape(-1, size)), pa.list_(pa.int64()))],
            ["fold", "i", "v"],
        )

    parts = rows.select("x", "y", "fold").mapInArrow(run, "fold int, i int, v array<long>")
    # posexplode and sum: whole numbers add up the same in any order, and partial sums keep (FOLDS * size * size) rows a task
    sums = parts.select("fold", "i", F.posexplode("v").alias("j", "v")).groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((FOLDS, size, size))
    at = [sums.column(c).to_numpy() for c in ("fold", "i", "j")]
    out[tuple(at)] = sums.column("v").to_numpy() / (ONE * ONE)
    return out


def solve(sums: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of constant and features; the constant is not held back."""
    g, b = sums[:-1, :-1], sums[:-1, -1]
    hold = ridge * max(g[0, 0], 1.0) * np.eye(len(g))
    hold[0, 0] = 1e-9
    return np.linalg.solve(g + hold, b)


def fitted(sums: np.ndarray) -> np.ndarray:
    """One row of weights per fold, from the other folds, and one from all, with the ridge that errs least on the folds left out."""
    whole = sums.sum(axis=0)

    def error(ridge: float) -> tuple[float, list[np.ndarray]]:
        ws = [solve(whole - own, ridge) for own in sums]
        return sum(w @ own[:-1, :-1] @ w - 2 * (w @ own[:-1, -1]) + own[-1, -1] for w, own in zip(ws, sums)), ws

    ridge, (_, ws) = min(((r, error(r)) for r in RIDGES), key=lambda c: c[1][0])
    return np.array([*ws, solve(whole, ridge)])


def raw_scores(x: np.ndarray, model: Model, which: np.ndarray | int) -> np.ndarray:
    z = features(x, model.mean, model.deviation) / ONE
    return (z * model.weights[which]).sum(axis=1) if isinstance(which, np.ndarray) else z @ model.weights[which]


def pooled(step: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over steps in ascending order: the mean step and the share of label 1 of each pool."""
    pools: list[list[float]] = []
    for s, k, o in zip(step.tolist(), n.tolist(), ones.tolist()):
        pools.append([s * k, k, o])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([s / k for s, k, _ in pools]), np.array([o / k for _, k, o in pools])


def calibrated(raw: np.ndarray, corners: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.interp(np.clip(raw, LOW, HIGH) * STEPS, *corners)


def fit(rows: DataFrame) -> Model | None:
    """The model of labelled rows (x, y, fold); None without any."""
    moments = _moments(rows)
    if moments is None:
        return None
    model = Model(*moments, fitted(normal_equations(rows, *moments)), (np.zeros(1), np.zeros(1)))
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(b):
        raw = raw_scores(_matrix(b.column(0)), sent.value, b.column(2).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.rint(np.clip(raw, LOW, HIGH) * STEPS).astype(np.int64)), b.column(1)], ["step", "y"])

    steps = arrow_map(rows.select("x", "y", "fold"), run, "step long, y int").groupBy("step").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).toArrow().sort_by("step")
    return model._replace(corners=pooled(*(steps.column(c).to_numpy() for c in ("step", "n", "ones"))))


def scored(stats: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score of each row of statistics."""
    if model is None:
        return stats.select("doc_id", F.lit(0.5).alias("score"))
    sent = stats.sparkSession.sparkContext.broadcast(model)

    def run(b):
        score = calibrated(raw_scores(_matrix(b.column(1)), sent.value, FOLDS), sent.value.corners)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.clip(score, 0.0, 1.0))], ["doc_id", "score"])

    return arrow_map(stats.select("doc_id", "x"), run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document; statistics are taken once and written, labelled rows too."""
    stats = stored(measured(docs), "statistics")
    model = fit(stored(labelled(stats, labels), "labelled"))
    return scored(stats, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
