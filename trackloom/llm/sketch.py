"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k least distinct hashes of a text's word shingles, in order.
The sketch of a union is the k least of the sketches' union, so sketches merge
across parts; two sketches estimate resemblance, containment and the number of
distinct shingles. All of it is built-in array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import let, numbered, row_keys, text_or_empty

K, SHINGLE = 128, 5
_WHITE = " \t\n\x0b\x0c\r"


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of a text's word shingles, A-Z in lower case; a shorter text is one shingle, one without words none."""
    plain = F.btrim(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(_WHITE))
    words = F.transform(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - shingle), lambda i: F.xxhash64(*(h[i + j] for j in range(shingle))))
        return F.when(F.size(h) >= shingle, many).otherwise(F.array(F.xxhash64(h)))

    return F.when(plain == "", F.array().cast("array<long>")).otherwise(let(words, shingles))


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    return bottom(shingle_hashes(text, shingle), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of either text that both have; 1 if neither has any."""

    def share(both: Column) -> Column:
        return F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.greatest(F.size(both), F.lit(1))

    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(let(merge(a, b, k), share))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    place = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 if a has none."""
    j, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j / (1 + j) * (na + nb) / na))


def merge_all(rows: DataFrame, by: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each group: (by..., column), column null for groups of empty sketches.

    Equal hashes of a group become one row, within each task first, and the k
    least are taken within each task before rows are dealt out by group, so a
    group of any size sends at most k rows from a task.
    """
    one = rows.select(*by, F.explode_outer(column).alias("_h")).distinct()
    order = Window.partitionBy(*by).orderBy(F.col("_h").asc_nulls_last())
    ranked = one.withColumn("_r", F.dense_rank().over(order)).where(F.col("_r") <= k)
    return ranked.groupBy(*by).agg(F.sort_array(F.collect_set("_h")).alias(column))


def to_text(a: Column) -> Column:
    """16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def from_text(text: Column) -> Column:
    """The sketch that to_text() wrote."""
    n = F.length(text) / 16
    high = lambda i: F.conv(F.substring(text, i * 16 + 1, F.lit(8)), 16, 10).cast("long")
    low = lambda i: F.conv(F.substring(text, i * 16 + 9, F.lit(8)), 16, 10).cast("long")
    # The upper half's sign bit is folded first, so that nothing overflows.
    signed = lambda h: F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)
    return F.when(n < 1, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.shiftleft(signed(high(i)), 32).bitwiseOR(low(i)))
    )


def with_edits(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, next_id). The edited text has its last floor(n_chars / 2) code points
    replaced by as many first ones of the next document in descending order of
    ids, the first one after the last. A null text counts as empty. Documents
    with equal ids are ordered by hashes of their texts, null ids come last.
    Rows that repeat both id and text are one document: each gets its row, and
    all get the same. Texts are dealt out
    once, what a document lends (a beginning and a sketch) once more: both
    sides read the same columns, so that the planner reuses the exchange.
    """
    whole = text_or_empty(text)
    base = docs.select(F.col(id_col).alias("_id"), whole.alias("_text"))
    base = base.select("*", *row_keys("_id", F.col("_text")))
    light = base.select("_id", "k1", "k2", F.length("_text").alias("n")).distinct()
    order, total = numbered(light, "_id", "k1", "k2")
    borrowers = order.select(F.pmod(F.col("no") - 1, F.lit(max(total, 1))).alias("no"), F.col("k1").alias("to1"), F.col("k2").alias("to2"), F.floor(F.col("n") / 2).cast("int").alias("half"))
    lends = order.select("no", "k1", "k2").join(borrowers, "no").drop("no")

    texts = base.groupBy("k1", "k2").agg(F.first("_id").alias("_id"), F.first("_text").alias("_text"), F.count(F.lit(1)).alias("copies")).where("copies > 0")
    lent = texts.join(lends, ["k1", "k2"]).select(F.col("to1").alias("k1"), F.col("to2").alias("k2"), F.col("_id").alias("next_id"), F.expr("left(_text, half)").alias("start"), sketch(F.col("_text"), k, shingle).alias("next"))
    rows = texts.join(lent, ["k1", "k2"]).withColumn("n", F.length("_text"))
    rows = rows.withColumn("edited", F.expr("concat(left(_text, n - cast(floor(n / 2) as int)), start)"))
    rows = rows.select("_id", "n", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("_text"), k, shingle).alias("own"), sketch(F.col("edited"), k, shingle).alias("changed"), "next", "next_id", "copies")
    out = rows.select(
        F.col("_id").alias(id_col),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        to_text(F.col("own")).alias("fingerprint"),
        to_text(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("next"), k).alias("near_next"),
        F.col("next_id").alias(f"next_{id_col}"),
        F.col("copies").alias("_copies"),
    )
    # In two steps, so that no row holds a list of all its copies.
    step = 1000
    out = out.withColumn("_copies", F.explode(F.expr(f"transform(sequence(0, (_copies - 1) div {step}), i -> least({step}, _copies - i * {step}))")))
    return out.withColumn("_copies", F.explode(F.expr("sequence(1, cast(_copies as int))"))).drop("_copies")
