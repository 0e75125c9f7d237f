import random

import pytest
from tokenizers import Tokenizer

from trackloom.llm import bpe

ODD = [None, "", " \n\t", "Hello, world! It's 2024 and they'll've gone.", "ÀÉÎõü ŠŽ İstanbul ΣΑΣ Σ", "áé Å K", "x" * 3000, "<|endoftext|> <|startoftext|>abc<|endoftext|>", "日本語 текст עברית", "a\x1cb\x1d c\x85d e\xa0f", "\U0001f600‍\U0001f680 ok", "'s't're 's 12345 ½²", "don't DON'T"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.default_path())


def noise(rng):
    letters = "abcdefghijklmnopqrstuvwxyzéüßñ'’.,-0123456789 \n" + "etaoin" * 4
    return "".join(rng.choice(letters) for _ in range(rng.randrange(1, 300)))


def test_encoder_equals_the_library(encoder, library):
    rng = random.Random(3)
    texts = [t or "" for t in ODD] + [noise(rng) for _ in range(300)]
    ids, sizes = encoder.encode_batch(texts)
    at = 0
    for t, n in zip(texts, sizes.tolist(), strict=True):
        got = ids[at : at + n].tolist()
        want = library.encode(t, add_special_tokens=False).ids
        assert got == want, t
        assert bpe.decode_one(encoder.merges.tokens, ids[at : at + n]) == library.decode(want, skip_special_tokens=False)
        at += n


def test_other_scripts_are_proposed_and_verified(monkeypatch):
    """No text without an added token is encoded by the library, whatever its script."""
    scripts = {
        "ru": "Привет, мир! ЩУКА 12 №5 ё", "el": "Καλημέρα Κόσμε ΣΊΣΥΦΟΣ ὈΔΥΣΣΕΎΣ", "zh": "你好，世界。中文123测试", "ja": "日本語のテキスト、カタカナ", "ko": "안녕하세요 세계 한국어",
        "ar": "مرحبا بالعالم ١٢٣", "he": "שלום עולם", "hi": "नमस्ते दुनिया क्षत्रिय", "th": "สวัสดีชาวโลก", "emoji": "😀\u200d🚀 “quoted” — dash… Ⅷ ﬁ ǅ İI ẞ",
    }
    enc = bpe.Encoder(bpe.default_path())
    library, calls = enc.library, []

    class Counted:
        normalizer, pre_tokenizer = library.normalizer, library.pre_tokenizer

        def encode_batch(self, *a, **k):
            calls.append(a)
            return library.encode_batch(*a, **k)

    monkeypatch.setattr(enc, "library", Counted())
    rng = random.Random(9)
    texts = list(scripts.values())
    texts += ["".join(rng.choice(t) for _ in range(40)) for t in scripts.values() for _ in range(20)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x3FFFF)])) for _ in range(30)) for _ in range(300)]
    ids, sizes = enc.encode_batch(texts)
    ends = sizes.cumsum()
    for t, a, n in zip(texts, ends - sizes, sizes, strict=True):
        assert ids[a : a + n].tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert not calls
    enc.encode_batch(["Мир<|endoftext|>"])
    assert len(calls) == 1


def test_verification_tells_exactly_which_words_fail(encoder):
    """A proposed word passes if and only if merging yields it."""
    m, rng = encoder.merges, random.Random(4)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    passed = failed = 0
    for w in words:
        p = m.propose(w)
        pairs = list(zip(p, p[1:], strict=False))
        import numpy as np

        ok = not pairs or m.stays(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])).all()
        assert ok == (p == m.merge(w)), w
        passed, failed = passed + ok, failed + (not ok)
    assert passed > 100 and failed > 100


def test_a_worker_remembers_little(library):
    """Of 400,000 words, all new, a worker keeps under 120 MB at 200 bytes each; what it has forgotten it encodes as before."""
    enc, rng, most = bpe.Encoder(bpe.default_path()), random.Random(6), 0
    for k in range(10):
        text = " ".join("".join(rng.choice("abcdehiknorstu") for _ in range(9)) for _ in range(40_000))
        ids, _ = enc.encode_batch([text, "the first words again"])
        most = max(most, 200 * (len(enc._at) + len(enc._known_words)))
        if k in (0, 9):
            assert ids.tolist() == [i for e in library.encode_batch([text, "the first words again"], add_special_tokens=False) for i in e.ids]
    assert 60e6 < most < 120e6


def test_odd_documents(spark, odd_docs, library):
    docs = odd_docs.withColumnsRenamed({"lang": "ids", "source": "decoded"})
    out = bpe.encode(docs)
    assert out.columns == ["doc_id", "text", "n_chars", "ids", "decoded"]
    for r in out.collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.digests(bpe.encode(odd_docs.limit(0))).count() == 0
