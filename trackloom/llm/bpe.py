"""BPE encoding by speculation, and decoding.

A word's tokens are proposed by greedy longest match and then verified: a
sequence of tokens is the one that merging yields exactly when every adjacent
pair would stay a pair, and that is a property of the two tokens alone. All
adjacent pairs of a batch are checked together in arrays; only the words with
a failing pair are merged pair by pair.

Whether (x, y) stays a pair: undo the merges of x along its right edge and of y
along its left edge, latest first. In each state the two symbols at the border
existed side by side until the next merge of either; if a merge of the two has
a smaller rank than that one, merging would have crossed the border. Equal
ranks go to the left occurrence.

Pieces between white space are independent of each other for these
vocabularies, so each worker remembers the pieces that it has seen. How a piece
of other than Latin letters is put in lower case and cut into words is told by
the library's normaliser and word splitter, whose Unicode tables decide; its
words are proposed and verified like all others. The library itself encodes
only pieces that hold an added token.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import arrow_batches, text_or_empty

END = "</w>"
#: Marks a word that is in byte letters already; no word begins with white space.
SHOWN = " "
#: Unicode White_Space (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What str.split() cuts at besides.
CONTROLS = "\x1c\x1d\x1e\x1f"
#: How the vocabulary cuts a lower-case text into words (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces, and words, that a worker remembers before it starts afresh; about 200 bytes each.
REMEMBERED, REMEMBERED_WORDS = 300_000, 150_000
#: Letters up to which a word is merged by scanning for the least rank, not with a heap.
SHORT = 40

_white = re.compile(f"[{re.escape(WHITE)}]+")
_odd = re.compile("[ɐ-\U0010ffff]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Merges:
    """The merge table of a vocabulary file in arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.added.values()]) + 1
        self.tokens = np.full(size, None, object)
        for token, i in [*self.vocab.items(), *self.added.items()]:
            self.tokens[i] = token
        pairs = np.array([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in spec["model"]["merges"]], np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank[pairs[:, 2]] = np.arange(len(pairs))
        self.left[pairs[:, 2]], self.right[pairs[:, 2]] = pairs[:, 0], pairs[:, 1]
        code = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(code)
        self._code, self._rank_of, self._made = code[order], order, pairs[order, 2]
        # A token that merging never yields from its own letters is not proposed.
        sound = np.ones(size, bool)
        made = pairs[:, 2]
        holds = self.stays(pairs[:, 0], pairs[:, 1], self.rank[made])
        for t, a, b, ok in zip(made.tolist(), pairs[:, 0].tolist(), pairs[:, 1].tolist(), holds.tolist(), strict=True):
            sound[t] = ok and sound[a] and sound[b]
        self.inner = {t: i for t, i in self.vocab.items() if sound[i] and not t.endswith(END)}
        self.last = {t.removesuffix(END): i for t, i in self.vocab.items() if sound[i] and t.endswith(END)}
        self.longest = max(map(len, [*self.inner, *self.last]))
        self.letters = byte_letters()

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or a large number."""
        code = a << 32 | b
        at = np.minimum(np.searchsorted(self._code, code), len(self._code) - 1)
        return np.where(self._code[at] == code, self._rank_of[at], 1 << 60)

    def stays(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Which pairs merging leaves apart (before rank `limit`, if given)."""
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), 1 << 59) if limit is None else limit.copy()
        out, at = np.zeros(len(a), bool), np.arange(len(a))
        while len(at):
            fine = self.merge_rank(a, b) >= limit
            a, b, limit, at = a[fine], b[fine], limit[fine], at[fine]
            ra, rb = self.rank[a], self.rank[b]
            bare = (ra < 0) & (rb < 0)
            out[at[bare]] = True
            a, b, limit, at, ra, rb = (x[~bare] for x in (a, b, limit, at, ra, rb))
            back_a = ra > rb
            limit = np.minimum(limit, np.where(back_a, ra, rb + 1))
            a, b = np.where(back_a, self.right[a], a), np.where(back_a, b, self.left[b])
        return out

    def propose(self, word: str) -> list[int]:
        """Greedy longest match; word in byte letters, not empty."""
        out, at, n = [], 0, len(word)
        inner, last, longest = self.inner, self.last, self.longest
        while at < n:
            if n - at <= longest and (t := last.get(word[at:])) is not None:
                out.append(t)
                return out
            for end in range(min(n - 1, at + longest), at, -1):
                if (t := inner.get(word[at:end])) is not None:
                    out.append(t)
                    at = end
                    break
        return out

    def merge(self, word: str) -> list[int]:
        """Exact merging; word in byte letters, not empty."""
        ids = [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + END]]
        return self._scan(ids) if len(ids) <= SHORT else self._heap(ids)

    def _scan(self, ids: list[int]) -> list[int]:
        table, none = self._pairs(), (1 << 60, -1)
        found = [table.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best[1] < 0:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            found[i : i + 1] = []
            if i:
                found[i - 1] = table.get((ids[i - 1], ids[i]), none)
            if i < len(found):
                found[i] = table.get((ids[i], ids[i + 1]), none)
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        table = self._pairs()
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := table.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = table[(a, b)][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := table.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def _pairs(self) -> dict:
        if not hasattr(self, "_table"):
            a, b = self._code >> 32, self._code & 0xFFFFFFFF
            self._table = {(x, y): (r, t) for x, y, r, t in zip(a.tolist(), b.tolist(), self._rank_of.tolist(), self._made.tolist(), strict=True)}
        return self._table

    def words(self, words: list[str]) -> list[list[int]]:
        """Tokens of each word in byte letters: proposed, verified, else merged."""
        out = [self.propose(w) for w in words]
        sizes = np.array([len(x) for x in out], np.int64)
        flat = np.fromiter((i for x in out for i in x), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(words)), sizes)
        inside = of[1:] == of[:-1]
        codes, back = np.unique((flat[:-1] << 32 | flat[1:])[inside], return_inverse=True)
        fails = ~self.stays(codes >> 32, codes & 0xFFFFFFFF)
        for i in np.unique(of[1:][inside][fails[back]]).tolist():
            out[i] = self.merge(words[i])
        return out


class Encoder:
    """Encodes texts as the tokenizers library does with the same file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        self.library = Tokenizer.from_file(path)
        self._words = regex.compile(WORDS)
        self._added = re.compile("|".join(map(re.escape, self.merges.added)) or r"(?!)")
        self._known_words: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        self._at: dict[str, int] = {}
        self._pool, self._used = np.zeros(1 << 20, np.int32), 0
        self._start, self._size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _pieces(self, text: str) -> list[str]:
        """Between white space. Lower case at once where that is the same for each letter alone."""
        if (text.isascii() or not _odd.search(text)) and not self._added.search(text):
            text = text.lower()
        if any(c in text for c in CONTROLS):
            return [p for p in _white.split(text) if p]
        return text.split()

    def _cut(self, piece: str) -> list[str]:
        """The piece's words as the library cuts them, in byte letters and marked so."""
        normal, split = self.library.normalizer, self.library.pre_tokenizer
        piece = normal.normalize_str(piece) if normal is not None else piece
        return [SHOWN + w for w, _ in split.pre_tokenize_str(piece)]

    def _learn(self, pieces: list[str]) -> None:
        if len(self._known_words) > REMEMBERED_WORDS:
            self._known_words = {}
        known, letters = self._known_words, self.merges.letters
        plain = [p for p in pieces if not self._added.search(p)]
        cuts = [self._cut(p) if _odd.search(p) else self._words.findall(p.lower()) for p in plain]
        missing = list({w for c in cuts for w in c if w not in known})
        if missing:
            found = self.merges.words([w.removeprefix(SHOWN) if w.startswith(SHOWN) else "".join([letters[b] for b in w.encode()]) for w in missing])
            known.update(zip(missing, (np.array(x, "<i4").tobytes() for x in found), strict=True))
        packed = [known[c[0]] if len(c) == 1 else b"".join([known[w] for w in c]) for c in cuts]
        if len(plain) < len(pieces):
            rest = set(plain)
            odd = [p for p in pieces if p not in rest]
            packed += [np.array(e.ids, "<i4").tobytes() for e in self.library.encode_batch(odd, add_special_tokens=False)]
            plain += odd
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        ids, k = np.frombuffer(b"".join(packed), "<i4"), len(self._at)
        while k + len(plain) > len(self._start):
            self._start, self._size = (np.concatenate([x, np.zeros_like(x)]) for x in (self._start, self._size))
        while self._used + len(ids) > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        self._at.update(zip(plain, range(k, k + len(plain)), strict=True))
        self._start[k : k + len(plain)] = self._used + np.cumsum(sizes) - sizes
        self._size[k : k + len(plain)] = sizes
        self._pool[self._used : self._used + len(ids)] = ids
        self._used += len(ids)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and each text's number of ids."""
        if len(self._at) > REMEMBERED:
            self._forget()
        cuts = [self._pieces(t) for t in texts]
        pieces = [p for c in cuts for p in c]
        which = np.fromiter(map(self._at.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(which < 0)
        if len(new):
            words = [pieces[i] for i in new.tolist()]
            self._learn(sorted(set(words)))
            which[new] = np.fromiter(map(self._at.__getitem__, words), np.int64, len(words))
        sizes = self._size[which]
        ids = ragged(self._pool, self._start[which], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds = ends[np.concatenate([[0], np.cumsum([len(c) for c in cuts])]).astype(np.int64)]
        return ids, np.diff(bounds)


def ragged(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """pool[start : start + size] of each, in one array."""
    total = int(size.sum())
    shift = np.repeat(start - (np.cumsum(size) - size), size)
    return pool[np.arange(total) + shift]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file, made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def decode_one(tokens: np.ndarray, ids: np.ndarray) -> str:
    """The tokens joined by one space, as the library decodes without a decoder."""
    return " ".join(tokens[ids].tolist())


def encode(docs: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """docs with the columns ids (array of int) and decoded (the ids as text again).

    A null text counts as empty; an empty text, or one of white space only, has
    no ids and decodes to an empty text. Rows are independent: repeated rows
    get equal results, an empty table an empty one. Columns of docs named like
    the new ones are replaced.
    """
    path = path or default_path()
    keep = [c for c in docs.columns if c not in (ids, decoded)]
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            flat, sizes = enc.encode_batch(batch.column("_t").to_pylist())
            ends = np.concatenate([[0], np.cumsum(sizes)])
            columns = [batch.column(c) for c in keep]
            columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32))))
            if decoded:
                tokens = enc.merges.tokens
                columns.append(pa.array([decode_one(tokens, flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*keep, ids, *([decoded] if decoded else [])])

    rows = docs.withColumn("_t", text_or_empty(text)).select(*keep, "_t")
    out = rows.drop("_t").withColumn(ids, F.array(F.lit(0)))
    if decoded:
        out = out.withColumn(decoded, F.lit(""))
    return rows.mapInArrow(run, out.schema)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of encode()'s rows."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
