import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from trackloom.llm import tokenfile


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenfile.default_path())


@pytest.mark.parametrize("seed", range(6))
def test_grammar_round_trip(seed):
    rng = np.random.default_rng(seed)
    docs = [rng.integers(0, 5 + seed * 40, rng.integers(1, 400)).astype(np.int32) for _ in range(rng.integers(1, 30))]
    docs.append(np.full(500, 3, np.int32))
    shard = tokenfile.Shard(tokenfile.pack([*range(len(docs) - 1), None], docs, 1000))
    assert shard.doc_ids == [*range(len(docs) - 1), None]
    assert shard.sizes().tolist() == [len(d) for d in docs]
    for a, b, i in zip(docs, shard.all(), range(len(docs)), strict=True):
        assert a.tolist() == b.tolist() == shard.ids(i).tolist()
    assert len(shard.symbols) < sum(map(len, docs))
    flat = np.concatenate(docs)
    for place in rng.integers(0, len(flat), 30).tolist():
        i, at = shard.seek(place)
        assert shard.ids(i, at, at + 7).tolist() == docs[i][at : at + 7].tolist() and docs[i][at] == flat[place]
    with pytest.raises(IndexError):
        shard.seek(len(flat))
    assert tokenfile.lengths(shard.rules, shard.first).tolist() == shard.lengths.tolist()


def plain_counts(shard):
    """Most uses, none overlapping another, of any pair of neighbouring symbols within documents."""
    most, rows = 0, [shard.symbols[a:b].tolist() for a, b in zip(shard.begins, shard.begins[1:], strict=False)]
    for pair in {p for row in rows for p in zip(row, row[1:], strict=False)}:
        uses = 0
        for row in rows:
            k = 0
            while k < len(row) - 1:
                hit = (row[k], row[k + 1]) == pair
                uses, k = uses + hit, k + 1 + hit
        most = max(most, uses)
    return most


@pytest.mark.parametrize("seed", range(4))
def test_no_pair_is_left_that_is_frequent(seed):
    """Rounds end only when no pair can be replaced; a rule is used USES times when it is made."""
    rng = np.random.default_rng(seed)
    phrases = [rng.integers(0, 300, rng.integers(3, 40)) for _ in range(20)]
    docs = [np.concatenate([phrases[k] for k in rng.integers(0, 20, 30)]).astype(np.int32) for _ in range(12)]
    shard = tokenfile.Shard(tokenfile.pack(list(range(12)), docs, 1000))
    assert plain_counts(shard) < tokenfile.USES
    assert len(shard.symbols) < sum(map(len, docs)) / 4
    few = tokenfile.compress(np.concatenate(docs), np.cumsum([0, *map(len, docs[:-1])]), 1000, rules=3)
    assert tokenfile.expand(few[0], few[1], 1000).tolist() == np.concatenate(docs).tolist()


def test_rules_that_share_a_slot(monkeypatch):
    monkeypatch.setattr(tokenfile, "_slot", lambda a, b: (a % np.uint32(3)).astype(np.uint32))
    docs = [np.array([*range(8), *range(8)] * 12, np.int32)]
    shard = tokenfile.Shard(tokenfile.pack([1], docs, 1000))
    assert shard.all()[0].tolist() == docs[0].tolist() and plain_counts(shard) < tokenfile.USES


def test_a_run_of_one_id_is_found_by_place():
    docs = [np.full(100_000, 5, np.int32), np.arange(10, dtype=np.int32)]
    shard = tokenfile.Shard(tokenfile.pack([1, 2], docs, 1000))
    assert len(shard.symbols) < 40 and shard.ids(0, 99_990, 99_995).tolist() == [5] * 5
    assert shard.seek(100_003) == (1, 3) and shard.ids(1, 3).tolist() == [3, 4, 5, 6, 7, 8, 9]


def test_large_symbols_take_four_bytes():
    docs = [np.array([70_000, 5, 70_000, 5] * 50, np.int32), np.array([70_001], np.int32)]
    assert tokenfile.Shard(tokenfile.pack([*range(len(docs))], docs, 1000)).all()[0].tolist() == docs[0].tolist()


def test_encoder_equals_the_library(library):
    rng = random.Random(7)
    enc = tokenfile.Encoder(tokenfile.default_path())
    texts = ["", " ", "a", " a", "a ", "a  b", "a\nb c", "a \n b", "x\n\n y", "don't we'll", "<|endoftext|> a <|endoftext|>", "é日本 \U0001f600 ok", "end\n", "\tq w", "a\x85b \xa0 c", "a \u2003b c", "x\u3000 y"]
    texts += ["".join(rng.choice("ab cé'\n  .,1") for _ in range(60)) for _ in range(400)]
    for t, ids in zip(texts, enc.encode_batch(texts), strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_written_files_read_back(spark, odd_docs, library, tmp_path):
    from pyspark.sql import functions as F

    docs = odd_docs.withColumnsRenamed({"lang": "id", "source": "t"}).unionByName(odd_docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit("no id").alias("text"), F.lit("").alias("id"), F.lit("").alias("t"), F.lit(0).cast("long").alias("n_chars")).limit(1))
    tokenfile.write(docs, f"{tmp_path}/out", shard=1000)
    got = tokenfile.digests(tokenfile.read(spark, f"{tmp_path}/out")).collect()
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start][0] is None
    assert [r.doc_id for r in by_start][1:] == sorted(r.doc_id for r in odd_docs.collect())
    at = 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in by_start:
        ids = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    tokenfile.write(docs.limit(0), f"{tmp_path}/none")
    assert tokenfile.read(spark, f"{tmp_path}/none").count() == 0
