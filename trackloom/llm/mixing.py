"""Mixing sources to target weights by Pareto order sampling.

Targets: sources share all words by weight, each up to max_copies times its own
words, the excess shared again by weight. Every document gets as many whole
copies for certain as the target holds its source's words. The rest of the
target is spread over the documents as inclusion probabilities p of one copy
more; those that reach 1 are certain too. For the others each document draws u
from a hash of its id, and documents are ranked by
(u / (1 - u)) / (p / (1 - p)): Pareto order sampling of a sample whose size is
fixed in words. The sample is the longest prefix of that order that does not
exceed the words still due; what remains due, less than the next document, is
filled by further prefixes of the documents that still fit.

Inclusion falls slowly with a document's length (weight size ** -damping), so
that a few giants don't make up a source's sample.

The cut in a source's order is found from histograms: words by bucket of the
rank, then by finer bucket within the bucket that holds the cut, then row by
row within that. No source, however large, meets in one task, and texts are
never shuffled: the decision is a function of a row and its source's cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import cut, drop_scratch, maybe_broadcast

WEIGHTS, MAX_COPIES, DAMPING, SEED = (1.0, 2.0, 3.0), 3, 0.25, 20_240_229
#: Buckets of the rank at each of the two levels, and prefixes after the first.
BUCKETS, FILLS = 4096, 3


def word_count(text: Column) -> Column:
    """Number of maximal runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(rows: DataFrame, group: list[str], cap: str, weight: str, total: str) -> DataFrame:
    """rows with `filled` = least(cap, level * weight), summing up to each group's total.

    The level is found in closed form over rows in order of cap / weight.
    """
    ratio = F.when(F.col(weight) > 0, F.col(cap) / F.col(weight)).otherwise(F.lit(0.0))
    order = Window.partitionBy(*group).orderBy("_ratio", "_tie")
    rows = rows.withColumn("_ratio", ratio).withColumn("_tie", F.monotonically_increasing_id())
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    level = F.when(after > 0, (F.col(total) - before) / after)
    rows = rows.withColumn("_level", level)
    whole = Window.partitionBy(*group)
    level = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(whole)
    rows = rows.withColumn("_at", level)
    filled = F.when(F.col("_at").isNull(), F.col(cap)).otherwise(F.least(F.col(cap), F.col("_at") * F.col(weight)))
    return rows.withColumn("filled", filled).drop("_ratio", "_tie", "_level", "_at")


def _uniform(id_col: str, seed: int) -> Column:
    """A number in (0, 1) from the id; the same in every run."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), 12)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def _class(size: Column) -> Column:
    """Class of lengths, half a power of two wide."""
    return F.floor(F.log2(size.cast("double")) * 2).cast("int")


def _rank(u: Column, p: Column) -> Column:
    """Pareto rank mapped to (0, 1): q / (1 + q), q the ratio of the odds."""
    q = (u / (1 - u)) / (p / (1 - p))
    return q / (1 + q)


def _prefix(rows: DataFrame, due: DataFrame) -> DataFrame:
    """(no, cutoff, taken): the longest prefix by y of each source with words <= due.

    rows(no, y, size), due(no, due). Rows with equal y stand or fall together.
    """
    small = maybe_broadcast(due)

    def step(found: DataFrame, depth: int) -> DataFrame:
        # found(no, due, base, b0.., taken): narrows to the bucket in which the cut lies
        keys = [f"b{i}" for i in range(depth)]
        level = rows.withColumns({f"b{i}": _bucket(i) for i in range(depth + 1)}).join(maybe_broadcast(found), ["no", *keys])
        new = f"b{depth}"
        sums = level.groupBy("no", *keys, "due", "taken", new).agg(F.sum("size").alias("w"), F.max("y").alias("top"))
        order = Window.partitionBy("no", *keys).orderBy(new)
        sums = sums.withColumn("cum", F.col("taken") + F.sum("w").over(order))
        inside = F.col("cum") <= F.col("due")
        grouped = sums.groupBy("no", *keys, "due", "taken").agg(
            F.max(F.when(inside, F.col("cum"))).alias("full"),
            F.max(F.when(inside, F.col("top"))).alias("top"),
            F.min(F.when(~inside, F.col(new))).alias(new),
        )
        return grouped.select("no", *keys, new, "due", F.coalesce("full", "taken").alias("taken"), "top")

    def _bucket(i: int) -> Column:
        scaled = F.floor(F.col("y") * float(BUCKETS ** (i + 1)))
        return scaled.cast("long")

    found, tops = small.select("no", "due", F.lit(0).cast("long").alias("taken")), []
    for depth in range(2):
        found = cut(step(found, depth))
        tops.append(found.select("no", "taken", "top"))
        found = found.where(f"b{depth} is not null").drop("top")
    keys = ["b0", "b1"]
    last = rows.withColumns({"b0": _bucket(0), "b1": _bucket(1)}).join(maybe_broadcast(found), ["no", *keys])
    sums = last.groupBy("no", "due", "taken", "y").agg(F.sum("size").alias("w"))
    order = Window.partitionBy("no").orderBy("y")
    sums = sums.withColumn("cum", F.col("taken") + F.sum("w").over(order)).where("cum <= due")
    tops.append(sums.groupBy("no").agg(F.max("cum").alias("taken"), F.max("y").alias("top")))
    every = tops[0].unionByName(tops[1]).unionByName(tops[2])
    return every.groupBy("no").agg(F.max("taken").alias("taken"), F.coalesce(F.max("top"), F.lit(-1.0)).alias("cutoff"))


def plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    max_copies: int = MAX_COPIES,
    damping: float = DAMPING,
    seed: int = SEED,
    fills: int = FILLS,
) -> DataFrame:
    """One row for each source and class of lengths with all that decides a document's copies.

    (source, class, source_size, target, whole, p, cutoffs, limits): a document
    gets `whole` copies, and one more if for some i its size is at most
    limits[i] and its rank at most cutoffs[i].
    """
    size = word_count(F.col(text))
    light = cut(docs.select(F.col(source).alias("source"), size.alias("size"), _uniform(id_col, seed).alias("u")))
    used = light.where("size > 0").withColumn("class", _class(F.col("size")))
    classes = cut(used.groupBy("source", "class").agg(F.sum("size").cast("double").alias("words")))
    # Each source once, in order of code points (the order of bytes in UTF-8), null last.
    sources = light.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    share = F.element_at(F.array(*map(F.lit, map(float, weights))), F.pmod(F.col("no") - 1, F.lit(len(weights))) + 1)
    sources = sources.withColumn("no", number).withColumn("weight", share).withColumn("_all", F.lit(1))
    sources = sources.withColumn("total", F.sum("source_size").over(Window.partitionBy("_all")).cast("double"))
    sources = sources.withColumn("cap", F.col("source_size").cast("double") * max_copies)
    sources = water_fill(sources, ["_all"], "cap", "weight", "total")
    sources = cut(sources.select("no", "source", "source_size", F.col("filled").alias("target")))

    known = classes.withColumnRenamed("source", "_s").join(maybe_broadcast(sources), F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_copies)))).otherwise(0.0)
    near = F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)
    known = known.withColumn("sure", F.floor(near)).withColumn("rest", (near - F.col("sure")) * F.col("source_size"))
    known = known.withColumn("cap", F.col("words")).withColumn("weight", F.col("words") * F.pow(F.lit(2.0), -F.lit(damping) * F.col("class") / 2))
    known = water_fill(known, ["no"], "cap", "weight", "rest")
    p = F.col("filled") / F.col("words")
    known = known.withColumn("more", F.when(p > 1 - 1e-9, 1.0).when(p < 1e-9, 0.0).otherwise(p))
    known = known.withColumn("whole", (F.col("sure") + F.floor("more")).cast("int")).withColumn("p", F.col("more") - F.floor("more"))
    known = cut(known.select("no", "source", "class", "words", "source_size", "target", "whole", "p"))

    rows = used.withColumnRenamed("source", "_s").withColumnRenamed("class", "_c")
    rows = rows.join(maybe_broadcast(known.where("p > 0")), F.col("_s").eqNullSafe(F.col("source")) & (F.col("_c") == F.col("class")))
    rows = cut(rows.select("no", "size", _rank(F.col("u"), F.col("p")).alias("y")))
    drop_scratch(light)
    due = known.groupBy("no").agg(F.floor(F.first("target") - F.sum(F.col("whole") * F.col("words")) + 0.5).cast("long").alias("due"))
    cuts = due.withColumns({"cutoffs": F.array().cast("array<double>"), "limits": F.array().cast("array<long>")})
    for _ in range(1 + fills):
        cuts = cut(cuts)
        left = rows.join(maybe_broadcast(cuts), "no").where(~_taken(F.col("y"), F.col("size"), F.col("cutoffs"), F.col("limits")) & (F.col("size") <= F.col("due")))
        found = _prefix(left.select("no", "y", "size"), cuts.select("no", "due"))
        cuts = cuts.join(found, "no", "left").select(
            "no",
            (F.col("due") - F.coalesce("taken", F.lit(0))).alias("due"),
            F.concat("cutoffs", F.array(F.coalesce("cutoff", F.lit(-1.0)))).alias("cutoffs"),
            F.concat("limits", F.array("due")).alias("limits"),
        )
    cuts = cut(cuts)
    empty = sources.join(known.select("no").distinct(), "no", "left_anti").select("source", F.lit(None).cast("int").alias("class"), "source_size", "target", F.lit(0).alias("whole"), F.lit(0.0).alias("p"), "no")
    every = known.select(*empty.columns).unionByName(empty)
    return cut(every.join(cuts.drop("due"), "no", "left").drop("no"))


def _taken(y: Column, size: Column, cutoffs: Column, limits: Column) -> Column:
    hit = F.exists(F.arrays_zip(cutoffs.alias("cutoff"), limits.alias("limit")), lambda z: (y <= z["cutoff"]) & (size <= z["limit"]))
    return F.coalesce(hit, F.lit(False))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """docs with size, source_size, target, copies and taken (= size * copies).

    size is the number of words; a null text, and one without words, has size
    and copies 0. A null source is a source of its own. Documents draw by id:
    rows that repeat an id and a source's class of lengths draw alike, and all
    of them are taken or none. Without any word all targets are 0. Columns of
    docs named like the new ones are replaced.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    rules = plan(docs, id_col, text, source, **how)
    rules = rules.withColumnsRenamed({"source": "_source", "class": "_class"})
    size = word_count(F.col(text))
    rows = docs.drop(*new).withColumn("size", size).withColumn("_u", _uniform(id_col, how.get("seed", SEED)))
    rows = rows.withColumn("_c", F.when(F.col("size") > 0, _class(F.col("size"))))
    # A document without words takes its source's figures from any class.
    base = rules.groupBy("_source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    sides = rules.select("_source", "_class", "whole", "p", "cutoffs", "limits")
    rows = rows.join(maybe_broadcast(base), F.col(source).eqNullSafe(F.col("_source")), "left").drop("_source")
    rows = rows.join(maybe_broadcast(sides), F.col(source).eqNullSafe(F.col("_source")) & (F.col("_c") == F.col("_class")), "left")
    more = (F.col("p") > 0) & _taken(_rank(F.col("_u"), F.col("p")), F.col("size"), F.col("cutoffs"), F.col("limits"))
    copies = F.coalesce(F.col("whole"), F.lit(0)) + F.coalesce(more, F.lit(False)).cast("int")
    rows = rows.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
    return rows.select(*[c for c in docs.columns if c not in new], *new)


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of the mix: each row of docs as many times as it is taken."""
    packed = docs.select(*(F.col(c).alias(n) for c, n in zip((id_col, text, source), ("_id", "_text", "_from"), strict=True)), F.struct("*").alias("_row"))
    rows = mix(packed, "_id", "_text", "_from", **how).where("copies > 0")
    return rows.withColumn("_copy", F.explode(F.expr("sequence(1, copies)"))).select("_row.*")
