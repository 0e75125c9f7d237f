"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each has a logistic model over
word features and over the probabilities of the categories before it. In
training these earlier probabilities are out of fold: a row's comes from a
model that has not seen the row, as it will be for rows scored later.

Features are the distinct words of a text and the first 4 to 8 letters of each
word, present or not, numbered by a hash. They are chosen by the
log-likelihood ratio of their counts in a category's rows and the others, for
each category its own, so that what speaks for one has no say in another but
through the chain. Counts are summed on the executors, and the chain is fitted in one task
over the chosen features of a bounded sample of labelled documents, so the
driver holds the features' places and the weights only.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import arrow_batches, cut, drop_scratch, text_or_empty

#: Bound of the labelled sample, features chosen for a category, folds.
SAMPLE, FEATURES, FOLDS = 12_000, 3000, 5
#: Least log-likelihood ratio of a feature.
LEAST = 8.0
PLACES, REMEMBERED = 1 << 22, 300_000
L2, STEPS = 2e-5, 200
THRESHOLD = 0.3
#: Categories in the order of the chain, as conditions on the labels.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1", "toxic_low_quality": "toxic = 1 and quality = 0"}

_words = re.compile(r"[^\W_]+")


def word_places(word: str) -> list[int]:
    """Places of a lower-case word's features: itself and its beginnings."""
    names = [f"={word}", *(f"^{word[:k]}" for k in range(4, min(8, len(word)) + 1))]
    return [zlib.crc32(n.encode()) % PLACES for n in names]


def places(text: str) -> np.ndarray:
    return np.unique(np.array([p for w in set(_words.findall(text.lower())) for p in word_places(w)], np.int64))


@dataclass
class Model:
    """weights: a row for each category, a column for each feature; chain: for each earlier category."""

    names: list[str]
    features: dict[int, int]
    weights: np.ndarray
    chain: np.ndarray
    bias: np.ndarray

    def __post_init__(self):
        self._memory: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_memory"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._memory = {}

    def held(self, text: str) -> list[int]:
        """The model's features that a text has."""
        memory, features, found = self._memory, self.features, set()
        if len(memory) > REMEMBERED:
            memory.clear()
        for w in set(_words.findall(text.lower())):
            has = memory.get(w)
            if has is None:
                has = memory[w] = tuple(features[p] for p in word_places(w) if p in features)
            if has:
                found.update(has)
        return list(found)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return self.chained([self.held(t) for t in texts])

    def chained(self, sets: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(sets), len(self.names)))
        rows, columns = flat(sets)
        for c in range(len(self.names)):
            z = np.bincount(rows, self.weights[c][columns], len(sets)) + out[:, :c] @ self.chain[c][:c] + self.bias[c]
            out[:, c] = sigmoid(z)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def flat(sets: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(s) for s in sets]
    columns = np.fromiter((i for s in sets for i in s), np.int64, sum(sizes))
    return np.repeat(np.arange(len(sets)), sizes), columns


def logistic(rows: np.ndarray, columns: np.ndarray, dense: np.ndarray, y: np.ndarray, n_features: int, l2: float = L2, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the present features and of the dense columns, and the bias, by Adam on the whole sample."""
    n, k = dense.shape
    w, bias = np.zeros(n_features + k), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.bincount(rows, w[columns], n) + dense @ w[n_features:] + bias
        error = (sigmoid(z) - y) / n
        grad = np.concatenate([np.bincount(columns, error[rows], n_features), dense.T @ error]) + l2 * w
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.1 * (1 - 0.7 * step / steps)
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        bias -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w[:n_features], w[n_features:], float(bias)


def fit_chain(sets: list[list[int]], y: np.ndarray, names: list[str], features: dict[int, int], own: np.ndarray | None = None, folds: int = FOLDS) -> tuple[Model, np.ndarray]:
    """The chain fitted on feature sets and labels (a column for each category), and the out-of-fold probabilities of all but the last category.

    own: the features (columns) that each category (rows) uses; all if None.
    """
    return fit_flat(*flat(sets), y, names, features, own, folds)


def unfitted(names: list[str], features: dict[int, int]) -> Model:
    """A model that gives every text probability zero."""
    k = len(names)
    return Model(names, features, np.zeros((k, len(features))), np.zeros((k, k)), np.full(k, -40.0))


def fit_flat(all_rows: np.ndarray, all_columns: np.ndarray, y: np.ndarray, names: list[str], features: dict[int, int], own: np.ndarray | None = None, folds: int = FOLDS) -> tuple[Model, np.ndarray]:
    """fit_chain() with the sets as arrays: the row and the feature of each member."""
    n, c_all, n_features = len(y), len(names), len(features)
    model, apart = unfitted(names, features), np.zeros((n, c_all))
    if not n:
        return model, apart
    fold = np.arange(n) % folds
    for c in range(c_all):
        used = slice(None) if own is None else own[c][all_columns]
        rows, columns = all_rows[used], all_columns[used]
        dense = apart[:, :c]
        model.weights[c], model.chain[c, :c], model.bias[c] = logistic(rows, columns, dense, y[:, c], n_features)
        last = c == c_all - 1  # no later model needs its out-of-fold probabilities
        for f in range(folds if n >= folds and not last else 0):
            held, other = fold == f, fold != f
            inside = other[rows]
            to = np.cumsum(other) - 1
            w, chain, bias = logistic(to[rows[inside]], columns[inside], dense[other], y[other, c], n_features)
            z = np.bincount(rows, w[columns], n) + dense @ chain + bias
            apart[held, c] = sigmoid(z)[held]
    return model, apart


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", categories: dict[str, str] | None = None, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """Fit on at most `sample` labelled rows of docs, those with the least hashes of their ids.

    Of an id with several texts the one of the least hash is used. Labels with a null id or a null category are not used; an id labelled more
    than once has a category if any of its rows has it. Without usable labels
    the model gives every text probability zero.
    """
    categories = categories or CATEGORIES
    names = list(categories)
    ys = [f"_y{i}" for i in range(len(names))]
    marked = labels.select(F.col(id_col).alias("_id"), *(F.expr(f"cast({c} as int)").alias(y) for c, y in zip(categories.values(), ys, strict=True)))
    marked = marked.na.drop().groupBy("_id").agg(*(F.max(y).alias(y) for y in ys))
    chosen = marked.orderBy(F.xxhash64(F.lit("toxicity"), "_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text).alias("_t")).join(F.broadcast(chosen), "_id")
    # One text for each id, so the sample is bounded in rows, too.
    one = F.min(F.struct(F.xxhash64("_t").alias("h"), "_t"))["_t"].alias("_t")
    rows = cut(rows.groupBy("_id").agg(one, *(F.first(y).alias(y) for y in ys)))
    arrow_batches(docs.sparkSession)
    k = len(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((k + 1, PLACES), np.int16 if sample < 1 << 15 else np.int32)
        for b in batches:
            y = np.stack([b.column(c).to_numpy() for c in ys])
            for i, t in enumerate(b.column("_t").to_pylist()):
                at = places(t)
                seen[k][at] += 1
                for c in np.flatnonzero(y[:, i]):
                    seen[c][at] += 1
        at = np.flatnonzero(seen[k])
        for part in np.array_split(at, len(at) // 100_000 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(seen[c][part].astype(np.int64)) for c in range(k + 1))], ["place", *ys, "n"])

    schema = ", ".join(["place long", *(f"{y} long" for y in ys), "n long"])
    counts = cut(rows.mapInArrow(count, schema).groupBy("place").agg(*(F.sum(c).alias(c) for c in [*ys, "n"])).where("n >= 3"))
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(y).alias(y) for y in ys)).first()
    total = totals["n"]
    chosen_by: list[set[int]] = [set() for _ in ys]
    for c, y in enumerate(ys if total else []):
        score = _ratio(F.col(y).cast("double"), F.col("n").cast("double"), float(totals[y] or 0), float(total))
        best = counts.select("place", score.alias("score")).where(F.col("score") >= LEAST).orderBy(F.desc("score"), "place").limit(features)
        chosen_by[c] = {r.place for r in best.collect()}
    at = {p: i for i, p in enumerate(sorted(set().union(*chosen_by)))}
    own = np.array([[p in some for p in at] for some in chosen_by], bool).reshape(k, len(at))
    shared = docs.sparkSession.sparkContext.broadcast(at)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = Model([], shared.value, np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
        for b in batches:
            held = pa.array([sorted(has.held(t)) for t in b.column("_t").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("_id"), *(b.column(y) for y in ys), held], ["_id", *ys, "held"])

    def solve(t: pa.Table) -> pa.Table:
        t = t.sort_by("_id")
        held = t.column("held").combine_chunks()
        of = np.repeat(np.arange(t.num_rows), held.value_lengths().to_numpy())
        y = np.column_stack([t.column(c).to_numpy() for c in ys]).astype(float)
        m = fit_flat(of, held.flatten().to_numpy(), y, names, shared.value, own)[0]
        return pa.table({"model": pa.array([pickle.dumps((m.weights, m.chain, m.bias))], pa.binary())})

    picked = rows.mapInArrow(pick, rows.drop("_t").select("_id", *ys).withColumn("held", F.array(F.lit(0))).schema)
    solved = picked.groupBy(F.lit(0).alias("_all")).applyInArrow(solve, "model binary").collect()
    drop_scratch(rows)
    drop_scratch(counts)
    return Model(names, at, *pickle.loads(solved[0]["model"])) if solved else unfitted(names, at)


def _ratio(has, n, positives: float, total: float):
    """Log-likelihood ratio of a feature and a category; 0 where the feature speaks for neither."""

    def part(x, expected):
        return F.when((x > 0) & (expected > 0), x * F.log(x / expected)).otherwise(0.0)

    rate = positives / total
    other, lacks, lacks_other = n - has, F.lit(positives) - has, F.lit(total - positives) - (n - has)
    return part(has, n * rate) + part(other, n * (1 - rate)) + part(lacks, (total - n) * rate) + part(lacks_other, (total - n) * (1 - rate))


def score(docs: DataFrame, model: Model, text: str = "text", prefix: str = "p_") -> DataFrame:
    """docs with a probability for each category.

    A null text counts as empty and has the probabilities of a text without
    features. Rows are independent. Columns named like the new ones are replaced.
    """
    new = [f"{prefix}{n}" for n in model.names]
    keep = [c for c in docs.columns if c not in new]
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    # Only texts go to the workers, and only probabilities come back.
    @F.arrow_udf("array<double>")
    def probabilities(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            p = shared.value.probabilities(texts.to_pylist())
            yield pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))

    rows = docs.select(*keep, probabilities(text_or_empty(text)).alias("_p"))
    return rows.select(*keep, *(F.col("_p")[i].alias(c) for i, c in enumerate(new)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **how) -> DataFrame:
    """(id, p_<category>..., toxic): toxic if the category `toxic` reaches the threshold."""
    model = fit(docs, labels, id_col, text, **how)
    rows = score(docs.select(F.col(id_col), F.col(text).alias("_text")), model, "_text").drop("_text")
    return rows.withColumn("toxic", F.col("p_toxic") >= threshold)


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **how) -> DataFrame:
    """The rows of docs that are not toxic, all their columns unchanged."""
    model = fit(docs, labels, id_col, text, **how)
    rows = score(docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text")), model, "_text")
    return rows.where(F.col("p_toxic") < threshold).select("_row.*")
