"""Fuzzy line dedup with built-in functions.

Lines are normalised (trimmed, lower case); equal ones are one node. Two nodes
are linked if their edit similarity is 0.8 or more: one less the edit distance
in words over the longer line's words.

Nodes meet on pigeonhole blocks that no linked pair can miss. A SimHash of 64
bits has no such blocks at this similarity: 0.8 moves some 13 bits, and of one
word changed in 12 to 30 its blocks found 28 to 68 %. The blocks are therefore
pairs of neighbouring words: an edit of one word changes two pairs at most, so
lines within t edits share one of the 2t + 1 first pairs of either, in any
order common to all lines. Pairs of rare words come first, and those pairs that
are themselves frequent come last, both as a sample finds them; that affects
costs only.

Nodes that meet are compared by a signature before their texts are fetched: 256
bits, of which each word turns one over by its hash. An edit adds and removes one
word at most, so linked lines' signatures differ in at most 2t bits; those of
unrelated lines of up to some 250 words hardly ever do. The signature travels
with the keys, folded to 128 bits in lines of under LONG words, and ends nearly
all other meetings where they happen. For the edit distance each word is a
letter, one of LETTERS by its hash.

In a block of up to SMALL nodes all pairs are compared. In a larger one all are
compared with one representative; the links of all blocks then give groups, and
nodes that are not in their block's largest group are compared with the nodes
of other groups in the block, in the first large block that both share. Two
nodes of one group need no comparison. The
groups are therefore exactly the connected ones, while a block of many like
lines costs its size, not the square of it. Blocks that the sample finds
frequent are counted before they are dealt out, so that no task holds one.

Of each connected group the first occurrence stays, in order of document id and
line.
"""

from __future__ import annotations

from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import components, cut, drop_scratch, maybe_broadcast, release, row_keys, text_or_empty

SIMILARITY = 0.8
#: Rows up to which a counted table of line ids (of 40 bytes or so) is broadcast.
FEW = 400_000
#: Letters that stand for words in edit distances, from U+0100 on; below the surrogates.
LETTERS = 55_000
#: Bins in which words are counted, and the share of documents, one in SAMPLE, that is counted.
BINS, SAMPLE = 1 << 14, 8
#: Pairs of words that the sample has so often at least come last, the most frequent of them, at most COMMON; bins that tell them.
OFTEN, COMMON, PAIR_BINS = 8, 1 << 13, 1 << 16
#: Bins in which the sample's keys are counted, the share of them from which a bin's blocks are counted first, and lines of the sample from which it is thinned for that.
KEY_BINS, FREQUENT, THINNED = 1 << 12, 1 / 1000, 1 << 16
#: Keys of nodes that are dealt out at a time, in so many slices at most.
SLICE, MOST_SLICES = 8_000_000, 16
#: Nodes of a block up to which all its pairs are compared at once.
SMALL = 128
#: Words from which the folded signature tells too little.
LONG = 96
#: Longs of a signature.
SIGS = 4
_WHITE = " \t\n\x0b\x0c\r"


def normal(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(_WHITE)))


def words(norm: Column) -> Column:
    """Words of a normalised line. Single spaces, by far the usual case, need no pattern."""
    plain = reduce(lambda a, b: a & b, (~norm.contains(c) for c in ("  ", "\t", "\x0b", "\x0c", "\r")))
    return F.when(plain, F.split(norm, " ")).otherwise(F.split(norm, r"[\x20\x09-\x0D]+"))


def _lines(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, k1, k2, pos, h1, h2, hashes): every line that is not blank, with its words' hashes."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text).alias("t"))
    lines = rows.select("id", *row_keys("id", F.col("t")), F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    lines = lines.where(F.btrim("line", F.lit(_WHITE)) != "").select("id", "k1", "k2", "pos", normal(F.col("line")).alias("norm"))
    hashes = F.transform(words(F.col("norm")), lambda w: F.xxhash64(w))
    return lines.select("id", "k1", "k2", "pos", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"), hashes.alias("hashes"))


def _zipped(array: Column, body) -> Column:
    """body(x, y) of neighbours x, y of an array."""
    n = F.greatest(F.size(array) - 1, F.lit(0))
    return F.zip_with(F.slice(array, 1, n), F.slice(array, 2, n), body)


def _bin(x: Column, bins: int) -> Column:
    return x.bitwiseAND(F.lit(bins - 1)).cast("int")


def _counts(values: DataFrame, bins: int) -> list[int]:
    """For each bin the number of values(x) in it: `bins` numbers, whatever the table."""
    found = {r["bin"]: r["n"] for r in values.groupBy(_bin(F.col("x"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return [found.get(i, 0) for i in range(bins)]


def _table(numbers: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")


_MASK = (1 << 31) - 1


def _level(h: Column) -> Column:
    """A tagged hash's level."""
    return h.bitwiseAND(F.lit(63))


def _tagged(levels: Column) -> Column:
    """Words' hashes with their levels in the lowest bits, so that a pair's level is a sum."""
    return F.transform("hashes", lambda h: h.bitwiseAND(F.lit(~63)).bitwiseOR(F.get(levels, _bin(F.shiftright(h, 6), BINS)).cast("long")))


def _pair(a: Column, b: Column) -> Column:
    """The key of two neighbouring words, tagged; it fits an int."""
    return F.xxhash64(a, b).bitwiseAND(F.lit(_MASK))


def _common(some: DataFrame, levels: Column) -> Column:
    """For each bin of keys the level, 0 to 15, of the most frequent pair of some(hashes) in it; 16 bins in a long."""
    pairs = some.select(_tagged(levels).alias("w")).select(F.explode(_zipped(F.col("w"), _pair)).alias("pair"))
    found = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    packed = [0] * (PAIR_BINS // 16)
    for r in found.orderBy(F.desc("n"), "pair").limit(COMMON).collect():
        at, shift = divmod(r["pair"] % PAIR_BINS, 16)
        level = max(packed[at] >> 4 * shift & 15, min(15, int(log2(r["n"] / OFTEN)) + 1))
        packed[at] = packed[at] & ~(15 << 4 * shift) | level << 4 * shift
    return F.split(F.lit(",".join(str(x - (x >> 63 << 64)) for x in packed)), ",").cast("array<bigint>")


def _often(pair: Column, common: Column) -> Column:
    at = pair.bitwiseAND(F.lit(PAIR_BINS - 1))
    nibble = F.call_function("shiftright", F.get(common, F.shiftright(at, 4).cast("int")), (at.bitwiseAND(F.lit(15)) * 4).cast("int"))
    return nibble.bitwiseAND(F.lit(15))


def _with_keys(lines: DataFrame, levels: Column, common: Column, least: float) -> DataFrame:
    """lines(hashes) with size and keys, the first pairs of a line, those of rare words first and frequent ones last.

    T = most - 1 - 2 t pairs are common to lines of at most `most` words and t =
    most * (1 - least) edits, so the first 2 t + 1 - (most - n) of a line of n
    words hold one of them; that is greatest for most = n or n + 1. Lines of
    under four words are similar only if their words are equal.
    Each step is a column of its own, as it is used more than once.
    """
    mask = F.lit(_MASK)
    pairs = _zipped(F.col("_tagged"), lambda a, b: F.shiftleft(_level(a) + _level(b), 31).bitwiseOR(_pair(a, b)))
    pairs = F.transform(pairs, lambda p: F.shiftleft(_often(p, common), 38).bitwiseOR(p))
    edits = lambda n: F.floor(n * (1 - least) + 1e-9).cast("int")
    first = F.greatest(2 * edits(F.col("size")) + 1, 2 * edits(F.col("size") + 1))
    keys = F.array_distinct(F.transform(F.slice("_pairs", 1, first), lambda p: p.bitwiseAND(mask).cast("int")))
    whole = F.array(F.xxhash64("hashes").bitwiseAND(mask).cast("int"))
    out = lines.select("*", F.size("hashes").alias("size"), _tagged(levels).alias("_tagged"))
    out = out.withColumn("_pairs", F.sort_array(pairs))
    return out.withColumn("keys", F.when(F.col("size") < 4, whole).otherwise(keys)).drop("_tagged", "_pairs")


def _signature(hashes: Column) -> list[Column]:
    """SIGS longs; a word turns over one bit of one of them. Each takes its own words only: a step of a lambda costs more than a filter."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    of = lambda i: F.filter(hashes, lambda h: F.shiftrightunsigned(h, 62) == i)
    return [F.aggregate(of(i), F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(bit(h))).alias(s) for i, s in enumerate(_SIGS)]


_SIGS = [f"s{i}" for i in range(SIGS)]
#: What of a signature travels with a key: its halves folded, and of LONG lines also one long of each, which tells the other.
_FOLDED, _REST = ["s01", "s23"], ["s1", "s3"]


def occurrences(docs: DataFrame, id_col: str, text: str, least: float = SIMILARITY) -> tuple[DataFrame, list[int]]:
    """(id, k1, k2, pos, h1, h2, size, keys, s0..s3) of every line that is not blank, and the bins of frequent keys."""
    if least < SIMILARITY:
        raise ValueError(f"lines below an edit similarity of {SIMILARITY} need not share a pair of words")
    lines = _lines(docs, id_col, text)
    some = cut(lines.where(F.pmod("k1", F.lit(SAMPLE)) == 0).select("hashes"))
    levels = _table([min(31, round(log2(n + 1))) for n in _counts(some.select(F.explode("hashes").alias("x")).select(F.shiftright("x", 6).alias("x")), BINS)])
    common = _common(some, levels)
    share = max(1, some.count() // THINNED)
    few = some.where(F.pmod(F.xxhash64("hashes"), F.lit(share)) == 0) if share > 1 else some
    counts = _counts(_with_keys(few, levels, common, least).select(F.explode("keys").alias("x")), KEY_BINS)
    drop_scratch(some)
    rows = _with_keys(lines, levels, common, least).select("id", "k1", "k2", "pos", "h1", "h2", "size", "keys", *_signature(F.col("hashes")))
    return rows, [i for i, n in enumerate(counts) if n > sum(counts) * FREQUENT]


def _near(a: str, b: str, least: float, differ: list[Column]) -> Column:
    """Whether lengths of a and b and the bits in which signatures differ allow the similarity; whatever has it passes."""
    la, lb = F.col(f"{a}size"), F.col(f"{b}size")
    most = F.floor(F.greatest(la, lb) * (1 - least) + 1e-9)
    bits = reduce(lambda x, y: x + y, map(F.bit_count, differ))
    return (F.abs(la - lb) <= most) & (bits + F.abs(la - lb) <= 2 * most)


def _xors(a: str, b: str, sigs: list[str]) -> list[Column]:
    return [F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}")) for s in sigs]


def letters(norm: Column) -> Column:
    """A letter for each word of a normalised line."""
    code = F.transform(words(norm), lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(LETTERS)) + 256), 4, "0"))
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-16BE")


def edit_similar(a: Column, b: Column, least: float = SIMILARITY) -> Column:
    """Whether edit similarity, 1 - distance / longer length, is at least `least`.

    The distance is sought in a band of 16 and then in one as wide as allowed, so that few edits in long lines are found fast.
    """
    longer = F.greatest(F.length(a), F.length(b))
    most = F.floor(longer * (1 - least) + 1e-9).cast("int")
    few = (most > 16) & (F.levenshtein(a, b, 16) >= 0)
    return (F.abs(F.length(a) - F.length(b)) <= most) & (few | (F.call_function("levenshtein", a, b, most) >= 0))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, id_col: str, least: float) -> DataFrame:
    """pairs(a, b) with `ok`: whether their lines are similar. Fetches the texts of these lines only."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("lid")).distinct())
    wanted = cut(nodes.select("lid", "k1", "k2", "pos").join(maybe_broadcast(ids, FEW), "lid"))
    drop_scratch(ids)
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text).alias("_t"))
    rows = rows.select(*row_keys("_id", F.col("_t")), "_t")
    if wanted.limit(FEW + 1).count() <= FEW:
        rows = rows.join(F.broadcast(wanted), ["k1", "k2"])
    else:
        # At most 2**20 rows: the documents that can hold a wanted line, by 20 bits of their key.
        some = wanted.select(F.shiftrightunsigned("k1", 44).alias("_b")).distinct()
        rows = rows.join(F.broadcast(some), F.shiftrightunsigned("k1", 44) == F.col("_b"), "left_semi").join(wanted, ["k1", "k2"])
    found = rows.select("lid", normal(F.expr("element_at(split(_t, '\\n'), pos + 1)")).alias("norm"))
    found = found.select("lid", letters(F.col("norm")).alias("letters"))
    texts = cut(found.groupBy("lid").agg(F.first("letters").alias("letters")))
    one, two = texts.select(F.col("lid").alias("a"), F.col("letters").alias("na")), texts.select(F.col("lid").alias("b"), F.col("letters").alias("nb"))
    out = cut(pairs.join(one, "a").join(two, "b").select("a", "b", edit_similar(F.col("na"), F.col("nb"), least).alias("ok")))
    drop_scratch(wanted)
    drop_scratch(texts)
    return out


def _members(nodes: DataFrame, frequent: list[int], slices: int = 1, slice_: int = 0) -> DataFrame:
    """(key, lid, size, s01, s23, s1, s3, n, least): the nodes of each block with its size, of a slice's blocks of two and more; of those above SMALL also the least node.

    s01 and s23 are the signature's folded halves; s1 and s3 are null in lines of under LONG words. Nearly all keys have one node, so
    counting before dealing saves nothing but for the frequent ones.
    """
    folded = [F.col("s0").bitwiseXOR(F.col("s1")).alias("s01"), F.col("s2").bitwiseXOR(F.col("s3")).alias("s23")]
    rest = [F.when(F.col("size") >= LONG, F.col(s)).alias(s) for s in _REST]
    rows = nodes.select("lid", "size", *folded, *rest, F.explode("keys").alias("key"))
    if slices > 1:
        # Bits other than those of the bins of frequent keys, so that these spread over the slices.
        rows = rows.where(F.pmod(F.shiftright("key", 12), F.lit(slices)) == slice_)
    block, least = Window.partitionBy("key"), F.min("lid")
    few = rows
    if frequent:
        often = F.coalesce(F.get(_table([int(i in set(frequent)) for i in range(KEY_BINS)]), _bin(F.col("key"), KEY_BINS)) == 1, F.lit(False))
        few, many = rows.where(~often), rows.where(often)
    out = few.withColumns({"n": F.count(F.lit(1)).over(block), "least": least.over(block)}).where("n > 1")
    if frequent:
        sums = cut(many.groupBy("key").agg(least.alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"))
        out = out.unionByName(many.join(maybe_broadcast(sums, FEW), "key"))
    return cut(out.select("key", "lid", "size", *_FOLDED, *_REST, "n", F.when(F.col("n") > SMALL, F.col("least")).alias("least")))


def _ends(rows: DataFrame, a: str, *more: str) -> DataFrame:
    """rows(key, lid, size, s01, ..) as one end of a pair, its columns named by the prefix a."""
    return rows.select("key", *(F.col(c).alias(f"{a}{c}") for c in ("lid", "size", *_FOLDED, *_REST, *more)))


def _may(least: float) -> Column:
    """Whether sizes and what is known of the signatures of a_ and b_ allow the similarity."""
    folded, rest = _xors("a_", "b_", _FOLDED), _xors("a_", "b_", _REST)
    whole = _near("a_", "b_", least, [*rest, *(x.bitwiseXOR(y) for x, y in zip(folded, rest))])
    return _near("a_", "b_", least, folded) & F.coalesce(whole, F.lit(True))


def _closer(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Those of pairs(a, b) whose whole signatures allow the similarity."""
    known = nodes.select("lid", "size", *_SIGS)
    for end in ("a", "b"):
        pairs = pairs.join(known.select(F.col("lid").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in known.columns[1:])), end)
    return cut(pairs.where(_near("a_", "b_", least, _xors("a_", "b_", _SIGS))).select("a", "b"))


def line_links(nodes: DataFrame, docs: DataFrame, text: str, id_col: str, frequent: list[int], least: float = SIMILARITY) -> DataFrame:
    """Edges (a, b) between nodes(lid, size, s0.., keys, k1, k2, pos) that make the connected groups.

    Most meetings are chance. Lengths and folded signatures travel with the keys and end most of them, whole signatures nearly all others.
    The blocks of a slice of the keys are dealt out at a time, so that the disk
    holds one slice's keys, and of all slices only the pairs that signatures
    allow and the members of blocks above SMALL.
    """
    spark = nodes.sparkSession
    slices = max(1, min(MOST_SLICES, -(-(nodes.agg(F.sum(F.size("keys"))).first()[0] or 0) // SLICE)))
    met, kept = [], []
    for i in range(slices):
        members = _members(nodes, frequent, slices, i)
        few, many = members.where(F.col("n") <= SMALL), members.where(F.col("n") > SMALL)
        pairs = _ends(few, "a_").join(_ends(few, "b_"), "key").where((F.col("a_lid") < F.col("b_lid")) & _may(least))
        reps = _ends(many.where(F.col("lid") == F.col("least")), "a_")
        star = reps.join(_ends(many, "b_"), "key").where((F.col("a_lid") < F.col("b_lid")) & _may(least))
        met.append(cut(pairs.unionByName(star).select(F.col("a_lid").alias("a"), F.col("b_lid").alias("b")).distinct()))
        kept.append(cut(many.withColumnRenamed("least", "rep").drop("n")))
        drop_scratch(members)
        release(spark)
    near = _closer(reduce(DataFrame.unionByName, met).distinct(), nodes, least)
    first = _verified(near, nodes, docs, text, id_col, least).where("ok").select("a", "b")
    release(spark)
    groups = cut(components(first))
    rests = []
    for members in kept:
        of = groups.select(F.col("node").alias("lid"), F.col("root").alias("lid_root"))
        rows = cut(members.join(maybe_broadcast(of, FEW), "lid", "left").withColumn("lid_root", F.coalesce("lid_root", "lid")))
        # Whatever group is taken for a block's main one, of two nodes of different groups one is outside it.
        main = rows.groupBy("key", "lid_root").agg(F.count(F.lit(1)).alias("n"))
        main = main.groupBy("key").agg(F.max(F.struct("n", "lid_root"))["lid_root"].alias("main"))
        large = rows.groupBy("lid").agg(F.collect_set("key").alias("large"))
        whole = cut(rows.join(main, "key").join(large, "lid"))
        pairs = _ends(whole.where("lid_root <> main"), "a_", "lid_root", "rep", "large").join(_ends(whole, "b_", "lid_root", "large"), "key")
        # Of two that are both outside the main group, the pair is met from both sides; in the first of their blocks only.
        pairs = pairs.where((F.col("a_lid_root") != F.col("b_lid_root")) & (F.col("b_lid") != F.col("a_rep")) & _may(least))
        pairs = pairs.where(F.array_min(F.array_intersect("a_large", "b_large")) == F.col("key"))
        rests.append(cut(pairs.select(F.least("a_lid", "b_lid").alias("a"), F.greatest("a_lid", "b_lid").alias("b")).distinct()))
        for df in (members, rows, whole):
            drop_scratch(df)
        release(spark)
    left = _closer(reduce(DataFrame.unionByName, rests).distinct(), nodes, least)
    second = _verified(left, nodes, docs, text, id_col, least).where("ok").select("a", "b")
    for df in (*met, *rests, near, left, groups):
        drop_scratch(df)
    return first.unionByName(second)


def removals(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(k1, k2, gone): for each row of docs, by its keys, the places of lines that go."""
    spark = docs.sparkSession
    every, frequent = occurrences(docs, id_col, text, least)
    # Keys are computed again for the nodes rather than kept for each occurrence.
    found = cut(every.select("k1", "k2", "pos", "h1", "h2"))
    release(spark)
    at, of_line = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2", "pos"), ["size", "keys", *_SIGS]
    nodes = every.groupBy("h1", "h2").agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in of_line))
    nodes = cut(nodes.select("h1", "h2", "n", *of_line, *(F.col(f"at.{c}").alias(c) for c in ("id", "k1", "k2", "pos")), F.monotonically_increasing_id().alias("lid")))
    release(spark)
    groups = components(line_links(nodes, docs, text, id_col, frequent, least))
    release(spark)
    of = nodes.select("h1", "h2", "n", at.alias("at"), "lid").join(maybe_broadcast(groups, FEW), nodes["lid"] == groups["node"], "left")
    of = cut(of.where("n > 1 or root is not null").select("h1", "h2", "at", F.coalesce("root", "lid").alias("root")))
    # Every node gets its group's first occurrence, so occurrences need no meeting by group.
    stays = of.groupBy("root").agg(F.min("at").alias("stays"))
    of = cut(of.select("h1", "h2", "root").join(stays, "root").select("h1", "h2", *(F.col(f"stays.{c}").alias(f"s_{c}") for c in ("k1", "k2", "pos"))))
    drop_scratch(nodes)
    met = found.join(maybe_broadcast(of, FEW), ["h1", "h2"])
    gone = met.where("not (k1 = s_k1 and k2 = s_k2 and pos = s_pos)")
    out = cut(gone.groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone")))
    drop_scratch(found)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = SIMILARITY, new: str = "text_kept") -> DataFrame:
    """docs with n_lines, n_removed and the text of the lines that stay.

    Blank lines are kept and never compared. A null text stays null, with no
    lines; an empty one has one blank line. Rows that repeat both id and text
    count as one document, however many they are: all of them keep the same
    lines. A null id comes last in the order that tells which occurrence stays.
    Columns of docs named like the new ones are replaced. All lines of the edit
    similarity `least` are linked.
    """
    gone = removals(docs, id_col, text, least).withColumnsRenamed({"k1": "_k1", "k2": "_k2", "gone": "_gone"})
    rows = docs.drop(*({"n_lines", "n_removed", new} - {id_col, text}))
    ident, t = row_keys(id_col, text_or_empty(text))
    rows = rows.withColumns({"_r1": ident, "_r2": t})
    rows = rows.join(gone, (F.col("_r1") == F.col("_k1")) & (F.col("_r2") == F.col("_k2")), "left")
    cutting = F.col("_gone").isNotNull()
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    return rows.withColumns(
        {
            "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(text, "\n"))),
            "n_removed": F.when(cutting, F.size("_gone")).otherwise(0),
            new: F.when(cutting, kept).otherwise(F.col(text)),
        }
    ).drop("_r1", "_r2", "_k1", "_k2", "_gone")
