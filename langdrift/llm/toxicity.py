"""Toxicity categories by a chain of linear classifiers."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import giving_back, written

WORD = re.compile(r"[^\W\d_]+")
#: A document is rejected from this probability of the last category on.
THRESHOLD = 0.3
#: Words whose features a task keeps.
WORDS_KEPT = 150_000
#: Lengths of the word beginnings that are features beside whole words.
BEGINNINGS = (3, 4, 5, 6)


@lru_cache(maxsize=50_000)
def features_of_word(word: str) -> tuple[str, ...]:
    """A word and its beginnings, which also catch unseen inflections of a stem."""
    return (word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n))


def features_of_text(text: str | None) -> set[str]:
    """The distinct features of a whole text."""
    words = set(WORD.findall((text or "").lower()))
    return {f for w in words for f in features_of_word(w)}


@dataclass
class Link:
    """One classifier: log-odds = bias + weights of present features + chain weights times earlier probabilities."""

    bias: float
    weights: np.ndarray
    chain: np.ndarray


@dataclass
class ChainModel:
    """Categories in chain order, the selected features and a link for each category."""

    categories: list[str]
    vocabulary: dict[str, int]
    links: list[Link]
    rows: int = 0
    _words: dict = field(default_factory=dict, repr=False)

    def forget(self) -> None:
        """Empties what a task kept of words."""
        self._words.clear()
        features_of_word.cache_clear()

    def probabilities(self, texts) -> np.ndarray:
        """Probabilities of each text in each category; every link sees the earlier ones' probabilities."""
        get, cache = self.vocabulary.get, self._words
        out = np.zeros((len(texts), len(self.categories)))
        table = np.stack([x.weights for x in self.links]) if self.links else np.zeros((0, 0))
        for i, text in enumerate(texts):
            present: set[int] = set()
            for word in set(WORD.findall((text or "").lower())):
                ids = cache.get(word)
                if ids is None:
                    if len(cache) > WORDS_KEPT:
                        cache.clear()
                    ids = cache[word] = tuple(x for f in features_of_word(word) if (x := get(f)) is not None)
                present.update(ids)
            sums = table[:, list(present)].sum(1) if present else np.zeros(len(self.links))
            for c, link in enumerate(self.links):
                out[i, c] = sigmoid(link.bias + sums[c] + link.chain @ out[i, :c])
        return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(row: np.ndarray, col: np.ndarray, extra: np.ndarray, y: np.ndarray, n_features: int, ridge: float = 0.2, steps: int = 200) -> Link:
    """Logistic regression on sparse binary features (row, col) and dense ``extra`` columns in [0, 1].

    The mean log-loss plus ``ridge / 2 / rows`` times the squared weights (not the bias)
    is lowered by accelerated gradient steps, scaled for each weight by a bound of its
    curvature.
    """
    n, k = len(y), extra.shape[1]
    if not n or not 0 < y.sum() < n:
        share = float(y.mean()) if n else 0.0
        return Link(40.0 if share == 1 else -40.0, np.zeros(n_features), np.zeros(k))
    l2 = ridge / n
    width = np.bincount(row, minlength=n) + k + 1.0
    curve = np.concatenate([np.bincount(col, weights=width[row], minlength=n_features), extra.T @ width, [width.sum()]]) / (4 * n) + l2
    w = np.zeros(n_features + k + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    ahead, momentum = w.copy(), 1.0
    for _ in range(steps):
        z = ahead[-1] + np.bincount(row, weights=ahead[col], minlength=n) + extra @ ahead[n_features:-1]
        r = (sigmoid(z) - y) / n
        gradient = np.concatenate([np.bincount(col, weights=r[row], minlength=n_features), extra.T @ r, [r.sum()]])
        gradient[:-1] += l2 * ahead[:-1]
        new = ahead - gradient / curve
        step = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = new + (momentum - 1) / step * (new - w), new, step
    return Link(float(w[-1]), w[:n_features], w[n_features:-1])


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", max_rows: int = 12_000, features: int = 2_000, folds: int = 3, least: int = 2, least_z: float = 3.5) -> ChainModel:
    """Fits a classifier chain on labelled documents.

    ``labels`` has ``id_col`` and a 0/1 column for each category. The fit uses at most
    ``max_rows`` labelled documents, those with the least hash of their id; that is
    the bound of what reaches the driver. The documents' features are counted in
    Spark by category; of those in ``least`` documents that a two-proportion test finds
    beyond ``least_z``, the best ``features`` of each category take part, and a ridge
    penalty settles their weights. Categories are fitted in order: a link's
    earlier-category inputs are out-of-fold predictions, from models that have not seen
    the row, as a new document's earlier probabilities are too.

    Labels with a null id, or null in a category, are not used; of repeated labels the
    largest counts; documents that repeat a labelled id count each. Null and empty texts
    have no features. A category without examples of both kinds gets probability 0 or 1.
    Without labelled documents all probabilities are 0. Other columns are ignored.
    """
    spark = docs.sparkSession
    chosen = labels.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(*[F.max(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories)]).dropna()
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(max_rows).withColumnRenamed(id_col, "id")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    train = written(texts.select("id", "text", F.array(*[f"y{i}" for i in range(len(categories))]).alias("y")).repartition(max(2, spark.sparkContext.defaultParallelism)), "labelled")
    n_categories = len(categories)

    def count(frames):
        every, positive = Counter(), [Counter() for _ in range(n_categories)]
        for pdf in frames:
            for text, y in zip(pdf["text"], pdf["y"]):
                found = features_of_text(text)
                every.update(found)
                for c in range(n_categories):
                    if y[c]:
                        positive[c].update(found)
            if len(every) > 500_000:
                yield made(every, positive)
                every, positive = Counter(), [Counter() for _ in range(n_categories)]
        features_of_word.cache_clear()
        if every:  # a task may have no rows
            yield made(every, positive)

    def made(every, positive):
        return pd.DataFrame({"feature": list(every), "n": list(every.values())} | {f"n{c}": [positive[c][f] for f in every] for c in range(n_categories)})

    sums = ["n", *(f"n{c}" for c in range(n_categories))]
    counts = train.mapInPandas(giving_back(count), "feature string, " + ", ".join(f"{s} long" for s in sums)).groupBy("feature").agg(*[F.sum(s).alias(s) for s in sums]).filter(F.col("n") >= least)
    totals = train.agg(F.count(F.lit(1)), *[F.sum(F.col("y")[c]) for c in range(n_categories)]).first()
    n_all = totals[0]
    if not n_all:
        return ChainModel(categories, {}, [Link(-40.0, np.zeros(0), np.zeros(c)) for c in range(n_categories)])
    counts = written(counts, "feature-counts")
    vocabulary: dict[str, int] = {}
    for c in range(n_categories):
        p = int(totals[1 + c])
        if 0 < p < n_all:
            share = F.col("n") / n_all
            z = F.abs(F.col(f"n{c}") / p - (F.col("n") - F.col(f"n{c}")) / (n_all - p)) / F.sqrt(share * (1 - share) * (1 / p + 1 / (n_all - p)) + 1e-12)
            for r in counts.filter(z >= least_z).orderBy(F.desc(z), "feature").limit(features).select("feature").collect():
                vocabulary.setdefault(r[0], len(vocabulary))

    def encode(frames):
        for pdf in filter(len, frames):
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "present": [sorted({vocabulary[f] for f in features_of_text(t) if f in vocabulary}) for t in pdf["text"]]})

    data = train.mapInPandas(giving_back(encode), "id long, y array<int>, present array<int>").orderBy("id").toPandas()
    y = np.stack(data["y"].to_numpy()).astype(float)
    lengths = data["present"].map(len).to_numpy()
    row, col = np.repeat(np.arange(len(data)), lengths.astype(int)), np.concatenate([np.zeros(0, int), *data["present"].to_numpy()]).astype(int)
    fold = np.array([hash(int(i)) % folds for i in data["id"]])
    held, links = np.zeros((len(data), 0)), []
    for c in range(n_categories):
        links.append(fit_logistic(row, col, held, y[:, c], len(vocabulary)))
        out = np.zeros(len(data))
        for k in range(folds if c + 1 < n_categories else 0):
            own = fold != k
            place, inside = np.cumsum(own) - 1, own[row]
            link = fit_logistic(place[row[inside]], col[inside], held[own], y[own, c], len(vocabulary))
            z = link.bias + np.bincount(row, weights=link.weights[col], minlength=len(data)) + held @ link.chain
            out[~own] = sigmoid(z)[~own]
        held = np.column_stack([held, out])
    return ChainModel(categories, vocabulary, links, n_all)


def chain_probabilities(model: ChainModel, spark, text: str | Column = "text") -> Column:
    """A column: array with the probability of each category for whole texts. Null and empty texts have no features."""
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        for texts in batches:
            yield pd.Series(list(shared.value.probabilities(texts.tolist())))
        shared.value.forget()

    def probabilities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from giving_back(score)(batches)

    return F.pandas_udf(probabilities, "array<double>")(text)


def score_toxicity(docs: DataFrame, model: ChainModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a probability for each category, and ``rejected``: the last category reaches ``threshold``.

    One row for each row of ``docs``, whatever repeats or is null. No shuffle; the model
    is a few thousand weights.
    """
    p = docs.select(F.col(id_col).alias("doc_id"), chain_probabilities(model, docs.sparkSession, F.col(text_col)).alias("p"))
    columns = [F.col("p")[i].alias(f"p_{c}") for i, c in enumerate(model.categories)]
    return p.select("doc_id", *columns, (F.col("p")[len(model.categories) - 1] >= threshold).alias("rejected"))


#: The chain of the registered query: what the labels have, in this order.
CATEGORIES = ["low_quality", "toxic"]


def category_labels(labels: DataFrame) -> DataFrame:
    """Labels of the chain from a table with the 0/1 flags ``quality`` and ``toxic``: doc_id, low_quality, toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
