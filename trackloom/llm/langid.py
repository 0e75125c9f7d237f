"""Language identification with a blended-spectrum string kernel.

The kernel of two texts counts the character n-grams, 1 to 4 long, that both
hold (presence, not frequency), divided by the root of the product of their
numbers of n-grams. Classes are learned by one-versus-rest kernel ridge
regression on Nyström landmarks: with K the kernel between training texts and
landmarks and M the one among landmarks, the dual weights solve
(K'K + ridge * n * M) A = K'Y.

A text's scores are its kernel row times A. Both factors are matrices over
n-grams, so the landmarks' side is multiplied out once into one weight vector
per n-gram; a batch of texts is then one product of its presence matrix with
those weights. n-grams are numbered by a hash into 2**20 places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import arrow_batches, cut, maybe_broadcast, text_or_empty

LONGEST, PLACES = 4, 1 << 20
#: Bounds of the sample that the model is fitted on: texts and landmarks of a language, landmarks in all, texts in all.
TEXTS, LANDMARKS, MOST_LANDMARKS, MOST_TEXTS = 600, 64, 1024, 60_000
#: Parts of a language whose least hashes are taken before the language's.
PARTS = 32
RIDGE = 1e-4
UNKNOWN = "und"

_letter = re.compile(r"[^\W\d_]")
_rest = re.compile(r"[\W\d_]+")
_seen = np.zeros(PLACES, np.int64)


def grams(text: str) -> np.ndarray:
    """Places of the distinct n-grams of a text, lower case, other characters than letters as one space."""
    plain = " " + _rest.sub(" ", text.lower()).strip() + " "
    points = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    parts, rolled = [], np.zeros(len(points), np.uint64)
    for n in range(1, LONGEST + 1):
        if len(points) < n:
            break
        rolled = rolled[: len(points) - n + 1] * np.uint64(1_099_511_628_211) + points[n - 1 :] + np.uint64(1)
        mixed = (rolled ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        parts.append((mixed >> np.uint64(44)).astype(np.int64))
    places = np.concatenate(parts)
    at = np.arange(len(places))
    _seen[places] = at
    return places[_seen[places] == at]


@dataclass
class Model:
    """One row of weights for each place that a landmark holds."""

    labels: list[str]
    row_of: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """One-versus-rest scores, a row for each text."""
        sets = [grams(t) for t in texts]
        sizes = np.array([len(s) for s in sets])
        rows = self.row_of[np.concatenate(sets)] if sets else np.zeros(0, np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        out = np.empty((len(texts), len(self.labels)))
        for c in range(len(self.labels)):
            out[:, c] = np.add.reduceat(self.weights[:, c][rows], starts)
        return out / np.sqrt(sizes)[:, None]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Label and score of each text: the best class's share of the positive scores."""
        out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if _letter.search(t)]
        if not known or not self.labels:
            return out, score
        for at in range(0, len(known), 64):
            part = known[at : at + 64]
            s = self.scores([texts[i] for i in part])
            best = s.argmax(axis=1)
            plus = np.maximum(s, 0)
            share = plus.max(axis=1) / np.maximum(plus.sum(axis=1), 1e-12)
            for i, b, p in zip(part, best.tolist(), share.tolist(), strict=True):
                out[i], score[i] = self.labels[b], min(1.0, p)
        return out, score


def fit_sets(sets: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on the gram sets of labelled texts; the first texts of a label are its landmarks."""
    names = sorted(set(labels))
    if not names:
        return Model([], np.zeros(PLACES, np.int64), np.zeros((1, 0), np.float32))
    per = max(1, min(landmarks, MOST_LANDMARKS // len(names)))
    chosen = [i for n in names for i in [k for k, x in enumerate(labels) if x == n][:per]]
    size = np.array([len(s) for s in sets], float)
    held = np.unique(np.concatenate([sets[i] for i in chosen]))
    row_of = np.zeros(PLACES, np.int64)
    row_of[held] = np.arange(1, len(held) + 1)  # row 0: held by no landmark
    marks = np.zeros((len(held) + 1, len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        marks[row_of[sets[i]], j] = 1 / np.sqrt(size[i])
    k = np.stack([marks[row_of[s]].sum(axis=0, dtype=np.float64) / np.sqrt(len(s)) for s in sets])
    y = np.array([[float(x == n) for n in names] for x in labels])
    a = k.T @ k + ridge * len(sets) * k[chosen] + 1e-9 * len(sets) * np.eye(len(chosen))
    dual = np.linalg.solve(a, k.T @ y)
    return Model(names, row_of, (marks @ dual.astype(np.float32)).astype(np.float32))


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", texts: int = TEXTS, landmarks: int = LANDMARKS) -> Model:
    """Fit on at most `texts` texts of each language, those with the least hashes of their ids.

    Only rows with an id, a language, a text with a letter and held_out false
    are learned from; of an id with several texts in a language the one of the
    least hash is. With so many languages that these are more than MOST_TEXTS in
    all, fewer of each are taken. The least hashes are taken by parts of a
    language first, so no task sees a language's rows, however many.
    """
    usable = docs.where(F.col(id_col).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & ~held_out(id_col))
    ids = usable.select(F.col(id_col).alias("_id"), F.col(lang).alias("_lang")).distinct()
    ids = ids.select("*", F.xxhash64(F.lit("langid"), "_id").alias("_h"))

    def least(rows: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("_h", "_id")
        return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= texts)

    some = least(ids.withColumn("_part", F.pmod(F.shiftright("_h", 7), F.lit(PARTS))), "_lang", "_part").drop("_part", "_rank")
    chosen = cut(least(some, "_lang").drop("_h"))
    languages = chosen.where("_rank = 1").count()
    if languages * texts > MOST_TEXTS:
        chosen = chosen.where(F.col("_rank") <= max(1, MOST_TEXTS // languages))
    rows = usable.select(F.col(id_col).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_t"))
    one = F.min(F.struct(F.xxhash64("_t").alias("h"), "_t"))["_t"].alias("_t")
    sample = rows.join(maybe_broadcast(chosen), ["_id", "_lang"]).groupBy("_lang", "_rank").agg(one)
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [grams(t).astype(np.int32).tobytes() for t in b.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_lang"), b.column("_rank"), pa.array(sets, pa.binary())], ["lang", "rank", "grams"])

    found = sample.mapInArrow(run, "lang string, rank int, grams binary").toArrow()
    got = sorted(zip(found["lang"].to_pylist(), found["rank"].to_pylist(), found["grams"].to_pylist(), strict=True))
    return fit_sets([np.frombuffer(g, np.int32).astype(np.int64) for _, _, g in got], [name for name, _, _ in got], landmarks)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs' other columns with lang_pred and score.

    A null text, and one without a letter, is `und` with score 0, as is every
    text if the model knows no language. Rows are independent of each other.
    """
    keep = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, score = shared.value.predict(b.column("_t").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(label, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    rows = docs.select(*keep, text_or_empty(text).alias("_t"))
    schema = rows.drop("_t").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row, learned from the rows not held out."""
    model = fit(docs, id_col, text, lang)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text).alias("_text"))
    return predict(rows, model, "_text")
