"""SimHash fingerprints linked by a binary trie self-join.

A fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of a
text's word shingles. Two texts are linked if their fingerprints differ in at
most `budget` bits.

The self-join works on distinct fingerprints. The 64 bits are cut into
budget + agree blocks; two linked fingerprints agree on `agree` whole blocks, so
each fingerprint goes to one shard for each choice of so many blocks, keyed by
their values. One block is enough for some 10^8 fingerprints; with more of them
two or three are chosen, by their number, so that shards stay small.
Inside a shard the other bits form a binary trie, held as ranges of the sorted
fingerprints. Pairs of nodes are traversed together from the root: a step
descends both nodes by one bit, adds one to the pair's differing bits when the
children differ, and prunes the pair once the budget is exceeded. A shard
answers with a spanning forest of its links, so its output is linear in its
rows however dense a group is. A shard over MAX_SHARD rows is cut in parts and
dealt as pairs of parts, so no task holds more than two parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import arrow_batches, components, cut, row_keys, text_or_empty

#: Rows of a shard that one task joins; larger shards are cut in parts.
MAX_SHARD = 40_000
#: Node pairs expanded at once, and the pair size below which leaves are compared directly.
FRONTIER, LEAF = 200_000, 32


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of one text as an unsigned 64-bit number; 0 without words.

    Words are maximal runs of anything but ASCII white space, A-Z in lower case.
    """
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        hashed = [digest(b" ".join(words), 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        joined, a, b = b" ".join(words), [0, *ends[:-shingle].tolist()], (ends[shingle - 1 :] - 1).tolist()
        hashed = [digest(joined[i:j], 42) for i, j in zip(a, b, strict=True)]
    total = len(hashed)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, 65_536):
        part = np.frombuffer(b"".join(hashed[at : at + 65_536]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4) -> DataFrame:
    """docs' other columns with fp, the fingerprint as a signed long."""
    keep = [c for c in docs.columns if c != text]
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in batch.column("_t").to_pylist()]
            signed = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), signed], [*keep, "fp"])

    rows = docs.select(*keep, text_or_empty(text).alias("_t"))
    schema = rows.drop("_t").withColumn("fp", F.lit(0).cast("long")).schema
    return rows.mapInArrow(run, schema)


def masks(budget: int, agree: int) -> list[int]:
    """The bits of each choice of `agree` of budget + agree blocks; fingerprints within the budget agree on one choice."""
    n = budget + agree
    ends = [64 * i // n for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(blocks, agree)]


def best_agree(n: int, budget: int, max_shard: int) -> int:
    """How many blocks to choose for n fingerprints: that with the fewest rows dealt out, copies for a shard's parts included."""

    def dealt(agree: int) -> float:
        choices = masks(budget, agree)
        return sum(max(1.0, n / 2 ** m.bit_count() / max_shard) for m in choices)

    return min(range(1, 4), key=dealt)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def trie_pairs(values: np.ndarray, budget: int, split: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of sorted distinct uint64 values within budget bits.

    With split, only pairs of an index below split and one at or above it,
    values then being two sorted runs.
    """
    n = len(values)
    if split is None:
        start = np.array([[0, n, 0, n, 0, 63]], np.int64)
    else:
        start = np.array([[0, split, split, n, 0, 63]], np.int64)
    stack = [start]
    while stack:
        nodes = stack.pop()
        if len(nodes) > FRONTIER:
            half = len(nodes) // 2
            stack += [nodes[:half], nodes[half:]]
            continue
        same = (nodes[:, 0] == nodes[:, 2]) & (nodes[:, 1] == nodes[:, 3])
        small = ((nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2]) <= LEAF) | (nodes[:, 5] < 0)
        leaves = nodes[small]
        for at in range(0, len(leaves), 20_000):
            yield from _leaf_pairs(values, leaves[at : at + 20_000], budget)
        nodes, same = nodes[~small], same[~small]
        if not len(nodes):
            continue
        mid_a, mid_b = _middle(values, nodes[:, 0], nodes[:, 1], nodes[:, 5]), _middle(values, nodes[:, 2], nodes[:, 3], nodes[:, 5])
        out = []
        for one, two in ((0, 0), (1, 1), (0, 1), (1, 0)):
            if (one, two) == (1, 0):
                pick = ~same
            else:
                pick = np.ones(len(nodes), bool)
            a0, a1 = (nodes[:, 0], mid_a) if one == 0 else (mid_a, nodes[:, 1])
            b0, b1 = (nodes[:, 2], mid_b) if two == 0 else (mid_b, nodes[:, 3])
            errors = nodes[:, 4] + (one != two)
            pick &= (a1 > a0) & (b1 > b0) & (errors <= budget)
            out.append(np.column_stack([a0, a1, b0, b1, errors, nodes[:, 5] - 1])[pick])
        stack.append(np.concatenate(out))


def _middle(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """First index in [lo, hi) whose value has the bit set; the range is sorted and agrees above the bit."""
    lo, hi = lo.copy(), hi.copy()
    shift = bit.astype(np.uint64)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        one = ((values[np.minimum(mid, len(values) - 1)] >> shift) & np.uint64(1)).astype(bool)
        lo, hi = np.where(open_ & ~one, mid + 1, lo), np.where(open_ & one, mid, hi)


def _leaf_pairs(values: np.ndarray, leaves: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if not len(leaves):
        return
    wide = leaves[:, 3] - leaves[:, 2]
    count = (leaves[:, 1] - leaves[:, 0]) * wide
    for part in np.array_split(np.arange(len(leaves)), max(1, int(count.sum()) // 2_000_000 + 1)):
        if not len(part):
            continue
        c = count[part]
        row = np.repeat(part, c)
        k = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        i, j = leaves[row, 0] + k // wide[row], leaves[row, 2] + k % wide[row]
        near = (i != j) & (_popcount(values[i] ^ values[j]) <= budget)
        if near.any():
            yield i[near], j[near]


class Forest:
    """Union-find over 0..n-1 that takes pairs in arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Hook the larger root under the smaller until both ends agree."""
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            if len(a):
                np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.root[x]
            if (up == x).all():
                return x
            self.root[x] = self.root[up]
            x = up


def links(distinct: DataFrame, budget: int = 4, max_shard: int = MAX_SHARD, agree: int | None = None) -> DataFrame:
    """Edges (a, b) that connect exactly the linked values of distinct(fp)."""
    agree = best_agree(distinct.count(), budget, max_shard) if agree is None else agree
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    key = F.array(*(F.struct(F.lit(i).alias("rotation"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("block")) for i, m in enumerate(masks(budget, agree))))
    dealt = distinct.select("fp", F.explode(key).alias("k")).select("fp", "k.rotation", "k.block")
    sizes = dealt.groupBy("rotation", "block").count().where(F.col("count") > max_shard)
    large = cut(sizes.select("rotation", "block", F.ceil(F.col("count") / max_shard).cast("int").alias("n")))
    part = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    dealt = dealt.join(F.broadcast(large) if large.limit(10_001).count() <= 10_000 else large, ["rotation", "block"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    # A part meets every part, itself included: (p, q) with p <= q is one task.
    dealt = dealt.withColumn("p", part).withColumn("q", F.explode(F.expr("sequence(0, n - 1)")))
    dealt = dealt.select("fp", "rotation", "block", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), (F.col("p") <= F.col("q")).alias("first"))

    def run(t: pa.Table) -> pa.Table:
        fp = t.column("fp").to_numpy().view(np.uint64)
        if t.column("lo")[0].as_py() != t.column("hi")[0].as_py():
            first = t.column("first").to_numpy(zero_copy_only=False)
            one, two = np.sort(fp[first]), np.sort(fp[~first])
            values, split = np.concatenate([one, two]), len(one)
        else:
            values, split = np.sort(fp), None
        forest = Forest(len(values))
        if len(values) > 1 and split != 0 and split != len(values):
            for i, j in trie_pairs(values, budget, split):
                forest.join(i, j)
        root = forest.find(np.arange(len(values)))
        linked = root != np.arange(len(values))
        return pa.table({"a": values[linked].view(np.int64), "b": values[root[linked]].view(np.int64)})

    grouped = dealt.groupBy("rotation", "block", "lo", "hi")
    return grouped.applyInArrow(run, "a long, b long").distinct()


def _roots(rows: DataFrame, id_col: str, budget: int) -> DataFrame:
    """(fp, least, root): each fingerprint of rows, its least id and its component."""
    groups = cut(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    linked = components(links(groups.select("fp"), budget))
    return groups.join(linked, groups["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, budget: int = 4) -> DataFrame:
    """(id, fp, fingerprint, component_id), one row for each row of docs.

    component_id is the least id of all rows reachable over links. A null or
    empty text, and one of white space only, has fingerprint zero and is
    linked like any other. Repeated rows each get a row; a null id never is a
    component's least id unless all its ids are null, then the id is null.
    Other columns of docs, whatever their names, are not read.
    """
    rows = cut(fingerprints(docs.select(F.col(id_col), F.col(text).alias("_text")), "_text", shingle))
    roots = _roots(rows, id_col, budget)
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = roots.join(least, "root").select("fp", "component_id")
    out = rows.join(ids, "fp")
    return out.select(F.col(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, budget: int = 4) -> DataFrame:
    """One row of docs for each component: that of the least id, nulls last, then the least fingerprint and keys.

    Rows are told apart by id and text, so ids may be null or stand for several texts.
    """
    keyed = docs.select(F.col(id_col).alias("_id"), *(k.alias(n) for k, n in zip(row_keys(id_col, text_or_empty(text)), ("_k1", "_k2"), strict=True)), F.col(text).alias("_text"))
    rows = cut(fingerprints(keyed, "_text", shingle))
    ranked = rows.join(_roots(rows, "_id", budget).select("fp", "root"), "fp")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "fp", "_k1", "_k2")).alias("w")
    winners = ranked.groupBy("root").agg(first).select("w._k1", "w._k2")
    k1, k2 = row_keys(id_col, text_or_empty(text))
    kept = docs.withColumns({"_r1": k1, "_r2": k2})
    kept = kept.join(winners, (F.col("_r1") == F.col("_k1")) & (F.col("_r2") == F.col("_k2")), "left_semi")
    return kept.dropDuplicates(["_r1", "_r2"]).drop("_r1", "_r2")
