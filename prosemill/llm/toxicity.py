"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models; each model sees, beside the features, the probabilities of the
categories before it. It is trained on out-of-fold probabilities, those of models that didn't see the row, so that it meets
in training what it meets later. Neither the row's vocabulary nor its categories come from rows of its own fold: each fold
has the terms and marks that all others give.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled, learnable, workers, written

#: Most labelled rows that a chain is learnt from, the features it uses, the folds, and lengths of word beginnings.
ROWS, TERMS, FOLDS, STEMS = 16_000, 256, 5, (4, 5, 6)
EDGES = re.compile(r"^\W+|\W+$")


def terms(text: str) -> set[str]:
    """Words of a text in lower case, and word beginnings, which catch inflected forms, marked with a * at the end."""
    words = {EDGES.sub("", w) for w in set(text.lower().split())}
    words.discard("")
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}


@dataclass
class Chain:
    """weights[k]: of the terms, the earlier categories' log odds, the log of the number of terms present, and 1."""

    categories: list[str]
    vocabulary: list[str]
    weights: list[list[float]]

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        x = design(rows, len(self.vocabulary))
        out = np.empty((len(rows), 0))
        for w in self.weights:
            out = np.column_stack((out, sigmoid(np.column_stack((x, odds(out))) @ np.array(w))))
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        index = {t: i for i, t in enumerate(self.vocabulary)}
        return self.probabilities([present(t, index) for t in texts])

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def loads(text: str) -> Chain:
        return Chain(**json.loads(text))


def present(text: str, index: dict[str, int]) -> list[int]:
    """Numbers of the vocabulary's terms in a text."""
    found = set()
    for raw in set(text.lower().split()):
        word = raw if raw.isalnum() else EDGES.sub("", raw)
        if word in index:
            found.add(index[word])
        for n in STEMS:
            if len(word) >= n and (stem := word[:n] + "*") in index:
                found.add(index[stem])
    return sorted(found)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p)) / 4


def design(rows: list[list[int]], width: int) -> np.ndarray:
    x = np.zeros((len(rows), width + 2))
    for i, r in enumerate(rows):
        x[i, r] = 1
        x[i, width] = np.log1p(len(r))
    x[:, width + 1] = 1
    return x


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of a penalised logistic regression by Newton's method; the constant (all ones) isn't penalised."""
    w, penalty = np.zeros(x.shape[1]), np.where((x == 1).all(0), 1e-6, l2)
    for _ in range(steps):
        p = sigmoid(x @ w)
        r = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * r[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def fit(rows: list[list[int]], y: np.ndarray, folds: np.ndarray, vocabulary: list[str], categories: list[str], views: dict[int, np.ndarray] | None = None) -> Chain:
    """A chain on rows of term numbers; y has a column for each category, folds a number for each row. views: for each fold the
    design of all rows by the terms that the other folds give; without it all folds see the same terms."""
    x, out, weights = design(rows, len(vocabulary)), np.empty((len(rows), 0)), []
    for k in range(len(categories)):
        weights.append(logistic(np.column_stack((x, odds(out))), y[:, k]).tolist())
        unseen = np.empty(len(rows))
        for f in np.unique(folds):
            seen = np.column_stack((views[f] if views else x, odds(out)))
            unseen[folds == f] = sigmoid(seen[folds == f] @ logistic(seen[folds != f], y[folds != f, k]))
        out = np.column_stack((out, unseen))
    return Chain(categories, vocabulary, weights)


#: A text is dense with marked words from this share of its words, and heavy from so many of them, repeats counted.
DENSE, HEAVY = 0.02, 3
CATEGORIES = ["dense", "heavy", "toxic"]


def fold_of(doc_id: Column) -> Column:
    """The fold of an id, by hash, so that folds don't follow the order of the ids."""
    return F.pmod(F.xxhash64(doc_id), F.lit(FOLDS)).cast("int")


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = ROWS, width: int = TERMS) -> Chain:
    """A chain learnt from labels (doc_id, toxic) on at most rows texts of docs, none of them held out.

    The table marks toxicity as a whole. The chain's earlier categories are made from it: dense, toxic and with at least DENSE
    of its words marked, and heavy, toxic with at least HEAVY marked words; the label itself is the last. Marked are words that
    only toxic texts have; how often they occur is no feature, which are the terms' presence alone.
    """
    workers(docs.sparkSession)
    sample = labelled(docs, labels, label, rows).select("doc_id", "text", "label", fold_of(F.col("doc_id")).alias("fold"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got: dict[int, tuple[Counter, Counter]] = {}
            for text, y, f in zip(batch["text"], batch["label"], batch["fold"]):
                got.setdefault(f, (Counter(), Counter()))[int(y > 0)].update(terms(text))
            yield pd.DataFrame([(t, f, c[1][t], c[0][t]) for f, c in got.items() for t in c[0].keys() | c[1].keys()], columns=["term", "fold", "toxic", "clean"])

    totals = {r["fold"]: (r["t"], r["c"]) for r in sample.groupBy("fold").agg(F.count_if(F.col("label") > 0).alias("t"), F.count_if(F.col("label") <= 0).alias("c")).collect()}
    by_fold = [F.sum(F.when(F.col("fold") != f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(FOLDS) for c in ("toxic", "clean")]
    sums = sample.mapInPandas(count, "term string, fold int, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias(f"toxic{FOLDS}"), F.sum("clean").alias(f"clean{FOLDS}"), *by_fold)
    sums = written(sums.filter(f"toxic{FOLDS} + clean{FOLDS} >= 5"), "term-sums")
    chosen = {}
    for f in range(FOLDS + 1):  # the last is that of all folds
        n = [sum(v[k] for g, v in totals.items() if g != f) for k in (0, 1)]
        a, b = (F.col(f"toxic{f}") + 0.5) / (n[0] + 1.0), (F.col(f"clean{f}") + 0.5) / (n[1] + 1.0)
        best = sums.filter(f"toxic{f} + clean{f} >= 5").select("term", F.col(f"toxic{f}").alias("toxic"), F.col(f"clean{f}").alias("clean"), ((a - b) * F.log(a / b)).alias("worth")).orderBy(F.desc("worth"), "term").limit(width).collect()
        chosen[f] = [r["term"] for r in best], {r["term"] for r in best if r["toxic"] >= 5 and r["clean"] * (n[0] + 1) * 20 <= r["toxic"] * (n[1] + 1)}
    vocabulary = chosen[FOLDS][0]
    every = sorted({t for words, _ in chosen.values() for t in words})
    index, marked = {t: i for i, t in enumerate(every)}, {f: marks for f, (_, marks) in chosen.items()}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, f in zip(batch["text"], batch["fold"]):
                words = Counter(w if w.isalnum() else EDGES.sub("", w) for w in text.lower().split())
                hits = sum(n for w, n in words.items() if w in marked[f] or any(w[:k] + "*" in marked[f] for k in STEMS if len(w) >= k))
                out.append((present(text, index), hits, words.total()))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fold": batch["fold"], "label": batch["label"], "found": [o[0] for o in out], "hits": [o[1] for o in out], "words": [o[2] for o in out]})

    got = sample.mapInPandas(read, "doc_id long, fold int, label int, found array<int>, hits long, words long").toPandas().sort_values("doc_id")
    found, hits, words = [set(map(int, f)) for f in got["found"]], got["hits"].to_numpy(), got["words"].to_numpy()

    def seen_as(terms: list[str]) -> list[list[int]]:
        numbers = [(i, index[t]) for i, t in enumerate(terms)]
        return [[i for i, n in numbers if n in f] for f in found]

    toxic = (got["label"].to_numpy() > 0).astype(float)
    y = np.column_stack((toxic * (hits >= np.maximum(1, DENSE * words)), toxic * (hits >= HEAVY), toxic))
    views = {f: design(seen_as(chosen[f][0]), len(chosen[f][0])) for f in range(FOLDS)}
    return fit(seen_as(vocabulary), y, got["fold"].to_numpy(), vocabulary, CATEGORIES, views)


def classify(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """Rows (doc_id, held_out, p_dense, p_heavy, score, predicted) of docs (doc_id, text): score is the probability of the last
    category, toxic, and predicted is 1 where it is at least 1/2.

    Null texts count as empty, a null id as the empty text for held_out. Repeated rows stay; an empty table gives an empty
    result; without labels every score is 1/2 at most. Other columns are ignored.
    """
    chain = learn(docs, labels, rows=rows).dumps()

    @F.pandas_udf("array<double>")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(list(Chain.loads(chain).score([t or "" for t in texts])))

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scores("text").alias("p"))
    return out.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), F.col("p")[0].alias("p_dense"), F.col("p")[1].alias("p_heavy"), F.col("p")[2].alias("score"), (F.col("p")[2] >= 0.5).cast("int").alias("predicted"))
