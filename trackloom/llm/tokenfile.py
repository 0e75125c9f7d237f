"""Token ids in files compressed by a Re-Pair grammar.

Documents are put in ascending order of their ids, encoded, and gathered in
shards of about SHARD ids. In each shard frequent pairs of neighbouring symbols
are replaced by new symbols, round after round, until no pair is found USES
times: a round counts the pairs, takes up to RULES of the most frequent, and
replaces their occurrences, the more frequent first where two overlap, and so
the same ones in all copies of a passage. A pair that is
too rare stays so until one of its symbols is replaced, so a round looks only at
places that were frequent or have changed. A pair never spans two documents, so
every document begins at a symbol.

A file is a Parquet table with a row for each shard: its number, its first
place in order, its numbers of documents and ids, and the payload. A payload
holds, little-endian: b"TLRP", version and halves of a symbol (u16 each), the
numbers of documents, rules and symbols and `first` (u32 each); ids of documents
(i64), a byte each for null; each document's first symbol (u32, and the end);
the rules' pairs (2 u32 each), their expansion lengths (u32), and the symbols:
the lower halves (u16), and if there are two halves the upper ones.
Symbols below `first` are ids, symbol first + i is rule i.
A document, and any run of its ids, is decoded from the symbols that it takes
and the rules below them; the lengths give the place of any id without
expanding what comes before it.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.llm.bpe import byte_letters, ragged
from trackloom.llm.common import arrow_batches, maybe_broadcast, text_or_empty

END_ID = 2
#: Ids of a shard, rules of a round, and least uses of a rule: with fewer it takes more room than it saves.
SHARD, RULES, USES = 1 << 20, 8192, 8
#: Texts whose words are looked up together, by their number of letters.
TOGETHER = 1 << 22
#: Pieces that a worker remembers before it starts afresh; about 200 bytes each.
REMEMBERED = 1_000_000
_HEAD = struct.Struct("<4sHHIIII")
_TABLE = 1 << 18


#: Matches pieces without white space and "<".
_usual = re.compile("[!-;=-~\xa1-\u167f\u1681-\u1fff\u2010-\u2027\u202a-\u202e\u2030-\u205e\u2060-\u2fff\u3001-\U0010ffff]+").fullmatch


class Encoder:
    """Ids of texts as the tokenizers library gives them with a byte-level vocabulary.

    Between single spaces a text falls into pieces that are encoded
    independently, each with its space. The library encodes the pieces that are
    new to the worker, many in a call: they are told apart by the tokens that
    begin with the space, or, at the beginning of a text, by an added token
    between them. It also encodes whole texts in which white space meets white
    space or an added token occurs.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        self._added = [t.content for t in added.values()]
        self._apart = min(added, default=None)
        self._opens = np.zeros(self.library.get_vocab_size(), bool)
        space = byte_letters()[32]
        for token, i in self.library.get_vocab().items():
            self._opens[i] = token.startswith(space)
        self._forget()

    def _forget(self) -> None:
        self._at: dict[str, int] = {}
        self._first: dict[str, int] = {}
        self._pool, self._used = np.zeros(1 << 20, np.int32), 0
        self._start, self._size, self._n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def _library_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and each one's number, straight from the library."""
        if pieces[0].startswith(" "):
            found = self.library.encode_batch_fast(["".join(pieces[i : i + 200]) for i in range(0, len(pieces), 200)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.int32) for e in found])
            begin = np.flatnonzero(self._opens[ids])
            if len(begin) == len(pieces):
                return ids, np.diff(np.append(begin, len(ids)))
        if self._apart is None:
            lists = [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
            return np.array([i for x in lists for i in x], np.int32), np.array([len(x) for x in lists], np.int64)
        mark = self.library.id_to_token(self._apart)
        groups = [mark.join(["", *pieces[i : i + 500]]) for i in range(0, len(pieces), 500)]
        found = self.library.encode_batch_fast(groups, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.int32) for e in found])
        begin = np.flatnonzero(ids == self._apart)
        return ids[ids != self._apart], np.diff(np.append(begin, len(ids))) - 1

    def _learn(self, pieces: set[str], known: dict[str, int], space: str) -> None:
        safe = list(filter(_usual, pieces))
        if len(safe) < len(pieces):
            rest = pieces.difference(safe)
            known.update(dict.fromkeys(rest, -1))
            safe += [p for p in rest if p and not p[0].isspace() and not p[-1].isspace() and not any(a in p for a in self._added)]
        if any("<" not in a for a in self._added):
            safe = [p for p in safe if not any(a in p for a in self._added)]
            known.update(dict.fromkeys(pieces.difference(safe), -1))
        if not safe:
            return
        ids, sizes = self._library_ids([space + p for p in safe])
        while self._n + len(safe) > len(self._start):
            self._start, self._size = (np.concatenate([x, np.zeros_like(x)]) for x in (self._start, self._size))
        while self._used + len(ids) > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        known.update(zip(safe, range(self._n, self._n + len(safe)), strict=True))
        self._start[self._n : self._n + len(safe)] = self._used + np.cumsum(sizes) - sizes
        self._size[self._n : self._n + len(safe)] = sizes
        self._pool[self._used : self._used + len(ids)] = ids
        self._n, self._used = self._n + len(safe), self._used + len(ids)

    def _places(self, pieces: list[str], known: dict[str, int], space: str) -> np.ndarray:
        """Place of each of distinct pieces among those remembered, after learning the new ones; -1 for those to leave to the library."""
        out = np.fromiter(map(known.get, pieces, repeat(-2)), np.int64, len(pieces))
        new = np.flatnonzero(out == -2)
        if len(new):
            words = [pieces[i] for i in new.tolist()]
            self._learn(set(words), known, space)
            out[new] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return out

    def _looked_up(self, pieces: pa.Array, known: dict[str, int], space: str) -> np.ndarray:
        """Place of each piece; each distinct one is looked up once."""
        coded = pieces.dictionary_encode()
        places = self._places(coded.dictionary.to_pylist(), known, space)
        return places[coded.indices.to_numpy()] if len(places) else np.zeros(0, np.int64)

    def encode_batch(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return []
        if self._n > REMEMBERED:
            self._forget()
        cuts = pc.split_pattern(texts.cast(pa.large_string()), " ")
        counts, pieces = cuts.value_lengths().to_numpy(), cuts.flatten()
        begin = np.cumsum(counts) - counts
        first = self._looked_up(pieces.take(pa.array(begin)), self._first, "")
        which = self._looked_up(pieces, self._at, " ")
        which[begin] = first
        rest = np.minimum.reduceat(which, begin) < 0
        sizes = np.where(which < 0, 0, self._size[which])
        ids = ragged(self._pool, self._start[which], sizes)
        ends = np.cumsum(sizes)[begin + counts - 1]
        out = np.split(ids, ends[:-1])
        for i in np.flatnonzero(rest).tolist():
            text = texts[i].as_py()
            out[i] = np.array(self.library.encode(text, add_special_tokens=False).ids if text else [], np.int32)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint32(2_654_435_761) ^ b * np.uint32(2_246_822_519)) >> np.uint32(14)


def compress(ids: np.ndarray, starts: np.ndarray, first: int, rules: int = RULES, uses: int = USES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules' pairs and documents' first symbols; starts: documents' first ids.

    Symbols from `first` on are rules, in the order in which they were made.
    """
    seq = ids.astype(np.uint32)
    begins = np.zeros(len(seq) + 1, bool)
    begins[starts] = True
    made, count = [np.zeros((0, 2), np.uint32)], 0
    marked = np.zeros(_TABLE, bool)
    live = np.flatnonzero(~begins[1:-1])  # places of pairs that may be frequent
    while len(live):
        a, b = seq[live], seq[live + 1]
        code = a.astype(np.uint64) << np.uint64(32) | b
        pairs, times = np.unique(code, return_counts=True)
        # Every other place of a run of one symbol counts.
        twice = live[a == b]
        if len(twice):
            some, fewer = np.unique(code[a == b][_even(twice, seq[twice])], return_counts=True)
            times[np.searchsorted(pairs, some)] = fewer
        often = times >= uses
        if not often.any():
            break
        slots = _slot(a, b)
        marked.fill(False)
        marked[_slot((pairs[often] >> np.uint64(32)).astype(np.uint32), pairs[often].astype(np.uint32))] = True
        there = marked[slots]
        live, code, slots = live[there], code[there], slots[there]
        best = np.flatnonzero(often)
        # Of equal counts in an order that has nothing to do with places.
        best = best[np.lexsort((pairs[best] * np.uint64(0x9E3779B97F4A7C15), -times[best]))[:rules]]
        at, r = _replaced(live, code, slots, pairs[best], uses)
        used = np.bincount(r, minlength=len(best)) > 0
        kept = pairs[best[used]]
        made.append(np.column_stack([kept >> np.uint64(32), kept & np.uint64(0xFFFFFFFF)]).astype(np.uint32))
        seq[at] = (np.cumsum(used) - 1 + first + count).astype(np.uint32)[r]
        count += len(kept)
        stay = np.ones(len(seq) + 1, bool)
        stay[at + 1] = False
        place = np.cumsum(stay) - 1
        changed = place[at]
        live = place[live[stay[live]]]
        seq, begins = seq[stay[:-1]], begins[stay]
        live = np.concatenate([live, changed, changed[changed > 0] - 1])
        live = live[live < len(seq) - 1]
        live = live[~begins[live + 1]]
        again = np.zeros(len(seq), bool)
        again[live] = True
        live = np.flatnonzero(again)
    return seq, np.concatenate(made), np.flatnonzero(begins[:-1])


def _replaced(live: np.ndarray, code: np.ndarray, slots: np.ndarray, best: np.ndarray, uses: int) -> tuple[np.ndarray, np.ndarray]:
    """Places to replace, no two of them neighbours, and each one's index in best; pairs left with fewer than `uses` places have none.

    live, code, slots: the places looked at, their pairs and slots. Pairs of
    best that share a slot are looked up one after the other.
    """
    own = _slot((best >> np.uint64(32)).astype(np.uint32), best.astype(np.uint32))
    rule, left = np.full(len(live), -1, np.int32), np.arange(len(best), dtype=np.int32)
    table, open_ = np.full(_TABLE, -1, np.int32), np.arange(len(live))
    while len(left):
        table.fill(-1)
        table[own[left][::-1]] = left[::-1]
        r = table[slots[open_]]
        some = r >= 0
        open_, r = open_[some], r[some]
        hit = best[r] == code[open_]
        rule[open_[hit]] = r[hit]
        open_, left = open_[~hit], left[table[own[left]] != left]
    some = rule >= 0
    at, r = _apart(live[some], rule[some])
    fine = np.bincount(r, minlength=len(best)) >= uses
    return at[fine[r]], r[fine[r]]


def _even(at: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a place is the first, third, ... of a run of neighbouring places of one kind."""
    new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(kind.astype(np.int64)) != 0)])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    return (np.arange(len(at)) - begin) % 2 == 0


def _apart(at: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of which no two are neighbours: those whose rule comes before the rules beside it, then, of what is left, again.

    All places of the first rule are among them, so every round makes progress.
    """
    if not len(at):
        return at, r
    even = _even(at, r)
    at, r = at[even], r[even]
    chosen = []
    for _ in range(2):
        beside = np.diff(at) == 1
        stays = np.ones(len(at), bool)
        stays[1:] &= ~(beside & (r[:-1] < r[1:]))
        stays[:-1] &= ~(beside & (r[1:] < r[:-1]))
        chosen.append((at[stays], r[stays]))
        near = np.zeros(len(at), bool)
        near[1:] |= beside & stays[:-1]
        near[:-1] |= beside & stays[1:]
        at, r = at[~stays & ~near], r[~stays & ~near]
        if not len(at):
            break
    at, r = (np.concatenate(x) for x in zip(*chosen, strict=True))
    order = np.argsort(at)
    return at[order], r[order]


def _by_level(rules: np.ndarray, first: int) -> list[np.ndarray]:
    """Rules in groups, each made of ids and rules of earlier groups only."""
    level, pairs = np.zeros(first + len(rules), np.int32), rules.astype(np.int64)
    while len(rules):
        now = level[pairs].max(axis=1) + 1
        if np.array_equal(now, level[first:]):
            break
        level[first:] = now
    return [np.flatnonzero(level[first:] == i) for i in range(1, int(level.max(initial=0)) + 1)]


def lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Expansion length of each rule."""
    out, pairs = np.ones(first + len(rules), np.int64), rules.astype(np.int64)
    for some in _by_level(rules, first):
        out[first + some] = out[pairs[some]].sum(axis=1)
    return out[first:]


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for: all rules are expanded once, level by level, then gathered."""
    sizes = np.concatenate([np.ones(first, np.int64), lengths(rules, first)])
    start, pairs = np.cumsum(sizes) - sizes, rules.astype(np.int64)
    pool = np.empty(int(sizes.sum()), np.int32)
    pool[:first] = np.arange(first)
    for some in _by_level(rules, first):
        parts, whole = pairs[some].ravel(), first + some
        n = sizes[whole]
        at = np.arange(int(n.sum())) + np.repeat(start[whole] - (np.cumsum(n) - n), n)
        pool[at] = ragged(pool, start[parts], sizes[parts])
    return ragged(pool, start[symbols], sizes[symbols])


def pack(doc_ids: list, ids: list[np.ndarray], first: int) -> bytes:
    """A shard's payload."""
    sizes = np.array([len(x) for x in ids], np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    first = max(first, int(flat.max()) + 1 if len(flat) else 0)
    seq, rules, begins = compress(flat, starts, first)
    halves = 1 if first + len(rules) <= 1 << 16 else 2
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join(
        [
            _HEAD.pack(b"TLRP", 1, halves, len(ids), len(rules), len(seq), first),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            null.tobytes(),
            np.append(begins, len(seq)).astype("<u4").tobytes(),
            rules.astype("<u4").tobytes(),
            lengths(rules, first).astype("<u4").tobytes(),
            *((seq >> (16 * h)).astype("<u2").tobytes() for h in range(halves)),
        ]
    )


class Shard:
    """A payload, open for reading."""

    def __init__(self, payload: bytes):
        magic, version, halves, n, n_rules, n_seq, self.first = _HEAD.unpack_from(payload)
        if magic != b"TLRP" or version != 1:
            raise ValueError("not a token shard")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, count, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", n), take("u1", n)
        self.doc_ids = [None if x else d for d, x in zip(ids.tolist(), null.tolist(), strict=True)]
        self.begins = take("<u4", n + 1)
        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = take("<u4", n_rules)
        self.symbols = sum(take("<u2", n_seq).astype(np.uint32) << (16 * h) for h in range(halves))

    def ids(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of document i; only symbols that hold some of them are expanded."""
        symbols = self.symbols[self.begins[i] : self.begins[i + 1]]
        ends = np.cumsum(self._spans(symbols))
        total = int(ends[-1]) if len(ends) else 0
        start, stop, _ = slice(start, stop).indices(total)
        out, stack = [], []
        low, high = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[low - 1]) if low else 0
        for s in symbols[low:high].tolist():
            stack.append(s)
            while stack:
                x = stack.pop()
                span = 1 if x < self.first else int(self.lengths[x - self.first])
                if before + span <= start or before >= stop:
                    before += span
                elif x < self.first:
                    out.append(x)
                    before += 1
                else:
                    one, two = self.rules[x - self.first].tolist()
                    stack += [two, one]
        return np.array(out, np.int64)

    def seek(self, place: int) -> tuple[int, int]:
        """The document that holds the shard's id number `place`, and the id's place in it."""
        ends = np.cumsum(self.sizes())
        if not 0 <= place < (int(ends[-1]) if len(ends) else 0):
            raise IndexError(place)
        i = int(np.searchsorted(ends, place, "right"))
        return i, place - (int(ends[i - 1]) if i else 0)

    def _spans(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        rule = symbols >= self.first
        out = np.ones(len(symbols), np.int64)
        out[rule] = self.lengths[symbols[rule] - self.first]
        return out

    def sizes(self) -> np.ndarray:
        """Ids of each document, from the expansion lengths."""
        ends = np.concatenate([[0], np.cumsum(self._spans(self.symbols))])
        return np.diff(ends[self.begins])

    def all(self) -> list[np.ndarray]:
        flat, ends = expand(self.symbols, self.rules, self.first), np.cumsum(self.sizes())
        return np.split(flat, ends[:-1]) if len(ends) else []


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about TOGETHER letters, so that a word that many texts share is looked up once."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= TOGETHER:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def write(docs: DataFrame, out: str, id_col: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID, shard: int = SHARD) -> None:
    """Write the ids of every text of docs to the folder `out`.

    A null text counts as empty, of which only end_id is written. Rows with
    equal ids follow each other in an order given by their texts; a null id
    comes first. An empty table gives a table without shards.
    """
    path = path or default_path()
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t")).repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, k = encoder(path), TaskContext.get().partitionId(), 0
        first = enc.library.get_vocab_size()
        names, held, total = [], [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([len(held)], pa.int64()), pa.array([total], pa.int64()), pa.array([pack(names, held, first)], pa.binary())],
                ["part", "shard", "n_docs", "n_ids", "payload"],
            )

        for b in _together(batches):
            for d, ids in zip(b.column("id").to_pylist(), enc.encode_batch(b.column("t")), strict=True):
                names.append(d)
                held.append(np.append(ids, np.int32(end_id)))
                total += len(held[-1])
                if total >= shard:
                    yield close()
                    names, held, total, k = [], [], 0, k + 1
        if held:
            yield close()

    rows.mapInArrow(run, "part int, shard int, n_docs long, n_ids long, payload binary").write.parquet(out)


def read(spark: SparkSession, out: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, ids): documents of the files in `out`; ids as little-endian unsigned 32-bit numbers, start the ids before them."""
    shards = spark.read.schema("part int, shard int, n_docs long, n_ids long, payload binary").parquet(out)
    arrow_batches(spark)
    sizes = shards.select("part", "shard", "n_ids")
    # Sums by part, then within each part: no place holds a row for every shard.
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("s0"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "shard", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("s1")).join(parts, "part")
    starts = starts.select("part", "shard", (F.col("s0") + F.col("s1")).alias("s"))
    rows = shards.select("part", "shard", "payload").join(maybe_broadcast(starts), ["part", "shard"]).select("s", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, payload in zip(b.column("s").to_pylist(), b.column("payload").to_pylist(), strict=True):
                shard = Shard(payload)
                every = shard.all()
                sizes = np.array([len(x) for x in every], np.int64)
                start = s + np.cumsum(sizes) - sizes
                for at in range(0, len(every), 512):
                    part = slice(at, at + 512)
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[part], pa.int64()), pa.array(start[part]), pa.array([x.astype("<u4").tobytes() for x in every[part]], pa.binary())], [id_col, "start", "ids"])

    return rows.mapInArrow(run, f"{id_col} long, start long, ids binary")


def digests(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of read()'s rows."""
    return rows.select(id_col, "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
