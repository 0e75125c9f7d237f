import numpy as np
import pytest
import xxhash

from trackloom.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, budget=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c d", "A b c d e\tf\x0bg \x1c h é", "x " * 70_000])
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def near_values(rng, n, flips):
    base = rng.integers(0, 2**63, n // 8 + 1, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n // 8 + 1, dtype=np.uint64)
    out = set()
    while len(out) < n:
        v = int(rng.choice(base))
        for b in rng.integers(0, 64, rng.integers(0, flips + 1)):
            v ^= 1 << int(b)
        out.add(v)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("seed", range(4))
def test_trie_pairs_are_all_pairs(seed):
    values = near_values(np.random.default_rng(seed), 300, 5)
    got = {(min(a, b), max(a, b)) for i, j in simhash.trie_pairs(values, 4) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if int(values[i] ^ values[j]).bit_count() <= 4}
    assert got == want


def test_more_blocks_for_more_rows():
    assert [simhash.best_agree(n, 4, simhash.MAX_SHARD) for n in (0, 10**6, 10**8, 10**10, 10**13)] == [1, 1, 1, 2, 3]
    for agree in (1, 2, 3):
        rng = np.random.default_rng(agree)
        choices = simhash.masks(4, agree)
        for _ in range(300):
            differ = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(differ & m == 0 for m in choices)


@pytest.mark.parametrize(("max_shard", "agree"), [(40_000, None), (3, None), (40_000, 2), (3, 3)])
def test_links_connect_the_true_components(spark, max_shard, agree):
    values = near_values(np.random.default_rng(9), 200, 6)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    edges = [(e.a, e.b) for e in simhash.links(df, max_shard=max_shard, agree=agree).collect()]
    at = {int(v): i for i, v in enumerate(values.view(np.int64))}
    forest = simhash.Forest(200)
    if edges:
        forest.join(np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
    got = forest.find(np.arange(200)).tolist()
    assert got == plain_components([int(v) for v in values])


def test_near_duplicates_of_odd_documents(spark, odd_docs):
    extra = odd_docs.withColumnsRenamed({"lang": "fp", "source": "component_id"})
    rows = odd_docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    roots = plain_components(fps)
    least = {}
    for r, c in zip(rows, roots, strict=True):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = sorted((r.doc_id, f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, roots, strict=True))
    got = simhash.near_duplicates(extra).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_keep_one_and_empty(spark, odd_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 7]
    assert simhash.keep_one(odd_docs.limit(0)).count() == 0
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0
