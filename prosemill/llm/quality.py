"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text falls into a bin, and the score is a sum of table entries: one for each feature, one for each chosen
pair. The tables are learnt by cyclic boosting: round after round, each feature in turn gets a shallow tree on what the sum
still has wrong; then the pairs that promise most get trees of one cut on either feature.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled, learnable, workers

#: Most labelled rows that a model is learnt from.
ROWS = 12_000

# --- features ------------------------------------------------------------------------------------------------------

FEATURES = ["words", "word_len", "longest_word", "distinct_words", "top_word", "repeats", "distinct_pairs", "upper", "digits", "stops", "marks", "symbols", "bars", "not_ascii", "spaces", "lines", "repeated_lines", "squeezed", "entropy", "inner_case"]
_KIND = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"#$%&*+=@^_~<>\\/{}[]", b"|", bytes(range(128, 256)), b" \t\r", b"\n"), 1):
    _KIND[list(_chars)] = _k


def features(text: str) -> list[float]:
    """FEATURES of a whole text; all 0 for one without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kind = np.bincount(_KIND, hist, 10) / len(raw)
    share = hist[hist > 0] / len(raw)
    counts = Counter(words)
    lines = text.split("\n")
    joined = set(zip(words, words[1:]))
    packed = zlib.compressobj(1)
    size = sum(len(packed.compress(raw[i : i + (1 << 20)])) for i in range(0, len(raw), 1 << 20)) + len(packed.flush())
    return [
        np.log1p(n), (len(raw) - kind[8] * len(raw)) / n, np.log1p(max(map(len, counts))), len(counts) / n, max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n, len(joined) / n, kind[1], kind[2], kind[3], kind[4], kind[5], kind[6], kind[7], kind[8],
        len(lines) / n, 1 - len(set(lines)) / len(lines), size / len(raw), float(-(share * np.log2(share)).sum()), sum(map(str.isupper, counts)) / len(counts),
    ]


# --- model ---------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """cuts: bin edges of each feature; tables and pair_tables: what a bin adds to the log odds."""

    base: float
    cuts: list[list[float]]
    tables: list[list[float]]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[list[list[float]]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows of features: vectorised additions of table entries."""
        b, total = self.bins(x), np.full(len(x), self.base)
        for i, t in enumerate(self.tables):
            total += np.asarray(t)[b[:, i]]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            total += np.asarray(t)[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-total))

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def loads(text: str) -> Model:
        raw = json.loads(text)
        return Model(**raw | {"pairs": [tuple(p) for p in raw["pairs"]]})


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float, l2: float) -> np.ndarray:
    """Steps for each bin of a tree of at most leaves leaves on the bins' gradients and curvatures."""
    parts, step = [(0, len(g))], np.zeros(len(g))
    worth = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + l2)
    while len(parts) < leaves:
        best = (1e-9, None)
        for a, b in parts:
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gr, hr = g[a:b].sum() - gl, h[a:b].sum() - hl
            gain = np.where((hl > least) & (hr > least), gl**2 / (hl + l2) + gr**2 / (hr + l2) - worth(a, b), 0)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (a, a + 1 + int(gain.argmax()), b))
        if best[1] is None:
            break
        a, c, b = best[1]
        parts.remove((a, b))
        parts += [(a, c), (c, b)]
    for a, b in parts:
        step[a:b] = -g[a:b].sum() / (h[a:b].sum() + l2)
    return step


def _cross(g: np.ndarray, h: np.ndarray, least: float, l2: float) -> tuple[float, np.ndarray]:
    """The best tree of one cut on each axis of a grid: its gain and its steps."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, ha = cg[:-1, :-1], ch[:-1, :-1]
    b, hb = cg[:-1, -1:] - a, ch[:-1, -1:] - ha
    c, hc = cg[-1:, :-1] - a, ch[-1:, :-1] - ha
    d, hd = cg[-1, -1] - a - b - c, ch[-1, -1] - ha - hb - hc
    gain = a**2 / (ha + l2) + b**2 / (hb + l2) + c**2 / (hc + l2) + d**2 / (hd + l2) - cg[-1, -1] ** 2 / (ch[-1, -1] + l2)
    gain = np.where(np.minimum(np.minimum(ha, hb), np.minimum(hc, hd)) > least, gain, 0)
    if not gain.size or gain.max() <= 0:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    step = np.empty_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            step[rows, cols] = -g[rows, cols].sum() / (h[rows, cols].sum() + l2)
    return float(gain.max()), step


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, pairs: int = 6, pair_rounds: int = 40, rate: float = 0.1, leaves: int = 3, least: float = 2.0, l2: float = 1.0) -> Model:
    """A model of labels y (0 or 1) on rows of features. Without rows it gives 1/2, with one class its smoothed share."""
    p = (y.sum() + 0.5) / (len(y) + 1)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.empty(0) for c in x.T]
    model = Model(float(np.log(p / (1 - p))), [c.tolist() for c in cuts], [[0.0] * (len(c) + 1) for c in cuts])
    if not len(y) or y.min() == y.max():
        return model
    b, total = model.bins(x), np.full(len(y), model.base)
    tables = [np.zeros(len(c) + 1) for c in cuts]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-total))
        return q - y, q * (1 - q)

    for _ in range(rounds):
        for i, t in enumerate(tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, i], g, len(t)), np.bincount(b[:, i], h, len(t)), leaves, least, l2)
            t += step
            total += step[b[:, i]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat, shape = b[:, i] * len(tables[j]) + b[:, j], (len(tables[i]), len(tables[j]))
        g, h = slopes()
        return *(np.bincount(flat, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)), flat

    gains = sorted(((_cross(*grid(i, j)[:2], least, l2)[0], (i, j)) for i, j in combinations(range(len(cuts)), 2)), key=lambda z: (-z[0], z[1]))
    model.pairs = [p for gain, p in gains[:pairs] if gain > 0]
    pair_tables = [np.zeros((len(tables[i]), len(tables[j]))) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), t in zip(model.pairs, pair_tables):
            g, h, flat = grid(i, j)
            step = rate * _cross(g, h, least, l2)[1]
            t += step
            total += step.ravel()[flat]
    model.tables, model.pair_tables = [t.tolist() for t in tables], [t.tolist() for t in pair_tables]
    return model


# --- over DataFrames -----------------------------------------------------------------------------------------------


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS) -> Model:
    """A model of labels(doc_id, label) learnt from at most rows of the texts of docs, none of them held out."""
    workers(docs.sparkSession)
    sample = labelled(docs, labels, label, rows)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "x": [features(t) for t in batch["text"]]})

    got = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text").mapInPandas(made, "doc_id long, label int, x array<double>").toPandas().sort_values("doc_id")
    return fit(np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES)), got["label"].clip(0, 1).to_numpy(float))


def scored(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """docs with a column of scores from 0 to 1. Null texts count as empty; all other columns stay."""
    workers(docs.sparkSession)
    dumped = model.dumps()

    @F.pandas_udf("double")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series(Model.loads(dumped).score(np.array([features(t or "") for t in texts], float).reshape(-1, len(FEATURES))))

    return docs.withColumn(score, made(F.col("text")))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) of docs (doc_id, text): predicted is 1 where score is at least 1/2.

    A null id counts as the empty text for held_out. Repeated rows stay; an empty table gives an empty result; without labels
    every score is 1/2. Other columns are ignored.
    """
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), learn(docs, labels, label, rows))
    return out.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, rows: int = ROWS) -> DataFrame:
    """docs whose score is at least least, with their own columns."""
    return scored(docs, learn(docs, labels, "quality", rows), "__score").filter(F.col("__score") >= least).drop("__score")
