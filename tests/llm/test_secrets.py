import hashlib
import random
import re

from trackloom.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_base(t):
    t = t or ""
    kinds = ["assign", "access", "hex"]
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 12]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 16]
    return sorted(found, key=lambda s: (s[1], kinds.index(s[0])))


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in secrets.digests(secrets.scan(df)).collect()}


def test_base_spans_are_the_plain_ones(spark):
    rng = random.Random(6)
    bits = ["password=", "Token: ", "api_key='", "APIKEY = ", "secret", ":", "=", " ", "abcdef0123456789", "AKIA", "ABCDEFGH12345678", "é", "\U0001f600", "zz9+/x_-.", "0123456789abcdef0", "passwd", '"', "\n", "ſecret=aaaaaaaaaaaaaaa", "token: secret: abcdefghijklmnop"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))) for _ in range(400)] + [None, ""]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        want = plain_base(t)
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in want) for k in ("assign", "access", "hex")], t
        assert r.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest()
        assert set(listed(want).split(",")) <= set(r.spans.split(","))


def test_weak_candidates_need_their_complements(spark):
    mixed = "Zx81Qm2vB7nP4kL9tR3w"
    texts = [
        f"user: alice then {mixed}",  # identifier and token
        f"nothing beside {mixed}",
        f"user: alice {'x ' * 400} {mixed}",  # out of reach
        f"user: alice {mixed} at https://db.example.com/x",
        "user: alice at https://db.example.com/x",  # no secret
        "AKIAABCDEFGHIJKLMN1 and 0123456789abcdef0 on https://db.example.com/x",
    ]
    got = run(spark, texts)
    kinds = lambda i: [s.split(":")[0] for s in got[i].spans.split(",") if s]
    assert kinds(0) == ["token"]
    assert kinds(1) == [] and kinds(2) == [] and kinds(4) == []
    assert kinds(3) == ["login", "token", "endpoint"]
    assert sorted(kinds(5)) == ["access", "endpoint", "hex"]
    start, end = map(int, got[0].spans.split(":")[1:])
    assert texts[0][start:end] == mixed


def test_linking_is_the_plain_interval_test(spark):
    rng = random.Random(9)
    parts = ["user: bob7 ", "Zx81Qm2vB7nP4kL9tR3w ", "https://h.example.com/p ", "0123456789abcdef0 ", "AKIAABCDEFGHIJKLMN1 ", "filler " * 30, "more filler " * 12]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(120)]
    got = run(spark, texts)
    find = {"token": secrets.TOKEN, "login": secrets.LOGIN, "endpoint": secrets.ENDPOINT}
    for i, t in enumerate(texts):
        base = plain_base(t)
        weak = [(k, m.start(), m.end()) for k, p in find.items() for m in re.finditer(p, t)]
        near = lambda s, kinds: any(o[0] in kinds and o[1] <= s[2] + secrets.REACH and o[2] >= s[1] - secrets.REACH for o in base + weak)  # noqa: E731, B023
        ident, secret, place = ("access", "login"), ("assign", "hex", "token"), ("endpoint",)
        need = {"token": (ident,), "login": (secret, place), "endpoint": (ident, secret)}
        linked = [s for s in weak if all(near(s, k) for k in need[s[0]])]
        want = sorted(base + linked, key=lambda s: (s[1], secrets.KINDS.index(s[0]), s[2]))
        assert got[i].spans == listed(want), t


def test_odd_documents(spark, odd_docs):
    docs = odd_docs.withColumnsRenamed({"lang": "assign", "source": "linked", "n_chars": "k1"})
    out = secrets.digests(secrets.scan(docs))
    assert out.count() == odd_docs.count()
    assert {r.spans for r in out.collect()} == {""}
    assert secrets.digests(secrets.scan(odd_docs.limit(0))).count() == 0
    twice = spark.createDataFrame([(1, "password=abcdefghijkl")] * 2 + [(None, "password=abcdefghijkl")], "doc_id long, text string")
    assert [r.n_assign for r in secrets.digests(secrets.scan(twice)).collect()] == [1, 1, 1]


def test_base_counts_are_those_of_sql(spark):
    """Counts of the base kinds in the test table, in SQL."""
    import os

    import duckdb
    import pytest

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    assign = """(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    longer = lambda pattern, group, n: f"len(list_filter(regexp_extract_all(coalesce(text, ''), '{pattern}', {group}), lambda x: length(x) >= {n}))"
    sql = f"SELECT doc_id, {longer(assign, 2, 12)}, {longer('AKIA[A-Z0-9]+', 0, 18)}, {longer('[0-9a-f]+', 0, 16)} FROM '{folder}/documents.parquet'"
    want = sorted(duckdb.sql(sql).fetchall())
    out = secrets.digests(secrets.scan(spark.read.parquet(f"{folder}/documents.parquet"))).collect()
    assert sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex) for r in out) == want and sum(map(sum, (w[1:] for w in want))) > 0
