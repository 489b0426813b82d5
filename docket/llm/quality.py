"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, and so has each chosen pair of features. Tables are learned by
cyclic boosting: round after round, every feature in turn gets a shallow tree (at most three splits of
its bins) fitted to the gradient; pairs of the greatest remaining gain follow in the same way over two-dimensional
bins. A score is the sum of one table entry per feature and pair, so scoring is a few vectorised
additions. Features describe the text only: never labels, language, source or id.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from docket.llm.common import slices, texts

FEATURES = (
    "log_chars", "word_length", "long_words", "unique_words", "top_word", "top_pair", "repeated_words", "symbols", "marks",
    "digits", "upper", "lines_repeated", "line_length", "pipes", "ends_with_mark", "words_with_symbols", "spaces", "compressed",
)
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
PLAIN = LETTERS + DIGITS + b" \n\r\t.,;:'\"()-?" + bytes(range(128, 256))


def features(text: str) -> list[float]:
    """FEATURES of a whole text; all finite, an empty text too."""
    raw = text.encode()
    size = max(len(raw), 1)
    found = text.split()
    n = max(len(found), 1)
    counts = Counter(found)
    pairs = Counter(zip(found, found[1:]))
    lines = [x for x in text.split("\n") if x]
    symbols = raw.translate(None, PLAIN)
    odd = sum(c for w, c in counts.items() if not w.isalnum() and not w.strip(".,;:?()\"'").isalnum())
    return [
        np.log1p(len(text)),
        len(text) / n,
        sum(c for w, c in counts.items() if len(w) > 12) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        max(pairs.values(), default=0) / n,
        sum(c for (a, b), c in pairs.items() if a == b) / n,
        len(symbols) / size,
        (size - len(raw.translate(None, b".,;:?"))) / size,
        (size - len(raw.translate(None, DIGITS))) / size,
        (size - len(raw.translate(None, UPPER))) / size,
        1 - len(set(lines)) / max(len(lines), 1),
        np.log1p(len(text) / max(len(lines), 1)),
        raw.count(b"|") / n,
        sum(x[-1] in ".!?:" for x in lines) / max(len(lines), 1),
        odd / n,
        (raw.count(b" ") + raw.count(b"\n")) / size,
        len(zlib.compress(raw, 1)) / size if raw else 1.0,
    ]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, splits: int, ridge: float) -> np.ndarray:
    """Values of a shallow regression tree over ordered bins with gradient and curvature sums g and h."""
    ends, value = [0, len(g)], lambda a, b: (g[a:b].sum(), h[a:b].sum())
    gain = lambda s, t: s * s / (t + ridge)
    for _ in range(splits):
        best = (1e-9, None)
        for a, b in zip(ends, ends[1:]):
            cg, ch = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            if len(cg):
                s, t = value(a, b)
                gains = gain(cg, ch) + gain(s - cg, t - ch) - gain(s, t)
                k = int(np.argmax(gains))
                if gains[k] > best[0]:
                    best = (gains[k], a + k + 1)
        if best[1] is None:
            break
        ends = sorted([*ends, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(ends, ends[1:]):
        s, t = value(a, b)
        out[a:b] = s / (t + ridge)
    return out


def _grid(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Values of the best two-level tree over a grid: one cut of each axis, four leaves."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    q = lambda c: [c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1]]
    gains = sum(s * s / (t + ridge) for s, t in zip(q(cg), q(ch)))
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    out = np.zeros(g.shape)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return out


class AdditiveModel:
    """Lookup tables over bins of single features and of pairs."""

    def __init__(self, bins: int = 32, coarse: int = 8, rounds: int = 120, pair_rounds: int = 60, pairs: int = 6, rate: float = 0.15, ridge: float = 4.0):
        self.bins, self.coarse, self.rounds, self.pair_rounds, self.n_pairs, self.rate, self.ridge = bins, coarse, rounds, pair_rounds, pairs, rate, ridge
        self.base, self.cuts, self.wide, self.tables, self.pair_tables = 0.0, [], [], [], {}

    def _bin(self, x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(cuts)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "AdditiveModel":
        at = lambda n: [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(x.shape[1])]
        self.cuts, self.wide = at(self.bins), at(self.coarse)
        rate = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        self.base = float(np.log(rate / (1 - rate)))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        if len(y) == 0 or y.min() == y.max():
            return self
        b, w, z = self._bin(x, self.cuts), self._bin(x, self.wide), np.full(len(y), self.base)
        for _ in range(self.rounds):
            for k, t in enumerate(self.tables):
                p = _sigmoid(z)
                step = self.rate * _tree(np.bincount(b[:, k], y - p, len(t)), np.bincount(b[:, k], p * (1 - p), len(t)), 3, self.ridge)
                t += step
                z += step[b[:, k]]
        gains, p = {}, _sigmoid(z)
        sums = lambda i, j, v: np.bincount(w[:, i] * (len(self.wide[j]) + 1) + w[:, j], v, (len(self.wide[i]) + 1) * (len(self.wide[j]) + 1)).reshape(len(self.wide[i]) + 1, -1)
        usable = [k for k, c in enumerate(self.wide) if len(c)]
        for i, j in combinations(usable, 2):
            g, h = sums(i, j, y - p), sums(i, j, p * (1 - p))
            gains[i, j] = (_grid(g, h, self.ridge) * g).sum()
        chosen = sorted(gains, key=lambda k: -gains[k])[: self.n_pairs]
        self.pair_tables = {k: np.zeros((len(self.wide[k[0]]) + 1, len(self.wide[k[1]]) + 1)) for k in chosen}
        for _ in range(self.pair_rounds):
            for (i, j), t in self.pair_tables.items():
                p = _sigmoid(z)
                step = self.rate * _grid(sums(i, j, y - p), sums(i, j, p * (1 - p)), self.ridge)
                t += step
                z += step[w[:, i], w[:, j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b, w, z = self._bin(x, self.cuts), self._bin(x, self.wide), np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            z += t[b[:, k]]
        for (i, j), t in self.pair_tables.items():
            z += t[w[:, i], w[:, j]]
        return _sigmoid(z)


def held_out(doc_id) -> "F.Column":
    """Rows that are never learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(rows: DataFrame, labels: DataFrame, most_rows: int = 20_000, label_col: str = "quality") -> AdditiveModel:
    """Fit on labelled rows (doc_id, text) that are not held out: at most ``most_rows``, those of the least hashed ids."""
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1)).where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    labelled = rows.join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # one text an id
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("x", pa.list_(pa.float64()))])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, schema.field(2).type)], schema=schema)

    found = labelled.mapInArrow(of, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id")
    x = np.array(found.x.tolist()) if len(found) else np.zeros((0, len(FEATURES)))
    return AdditiveModel().fit(x, found.y.to_numpy(float))


def _scores(model: AdditiveModel, found: list[str]) -> np.ndarray:
    return model.score(np.array([features(t) for t in found], float).reshape(-1, len(FEATURES)))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    The model is fitted on a bounded sample of labelled rows (``most_rows``), the score covers every whole text. A null
    text is empty and scored like an empty one. Without any usable label, or with one class only, every
    score is the labelled rate (0.5 if there is none). A null id counts as held out. Repeated rows are scored each; other columns are ignored.
    """
    rows = texts(docs, id_col, text_col)
    model = train(rows, labels, most_rows)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (s for batch in batches for s in slices(batch)):
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(_scores(model, some.column(1).to_pylist()))], schema=schema)

    scored = rows.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_poor(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier does not reject. Rows are judged where they lie, without a join.

    Each row is judged by its own text, whatever its id, also where it is null or repeated; null and empty texts by the score of an
    empty text. Repeated rows share their fate. Texts of any length are read whole; an empty table stays empty.
    """
    model = train(texts(docs, id_col, text_col), labels, most_rows)

    @F.pandas_udf(BooleanType())
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(_scores(model, [t or "" for t in batch]) >= threshold)

    return docs.where(good(F.col(text_col)))
