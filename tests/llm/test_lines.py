"""Line dedup against all pairs of lines; the plain version knows no blocks and no signatures."""

import random

import pytest
from pyspark.sql import functions as F

from trackloom.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ble", "ing", "the", "ou", "er", "sh") for b in ("on", "an", "ti", "re", "ly", "st", "nd", "ea")]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([2, 12, 60, 90]))) for _ in range(25)]
    out = []
    for i in range(n):
        picked = []
        for _ in range(rng.randrange(1, 5)):
            w = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(words)
            picked.append(rng.choice(["", " "]) + (" ".join(w)).capitalize())
        out.append((i, "\n".join(picked)))
    return out


def links_of_all_pairs(docs):
    """Kept lines of each (id, text) if every two lines of edit similarity 0.8 in words are linked."""
    first, order = {}, []
    for d, text in sorted(docs):
        for pos, line in enumerate(text.split("\n")):
            n = line.strip(" \t\n\x0b\x0c\r").lower()
            if n:
                order.append((d, pos, n))
                first.setdefault(n, len(first))
    names, root = [n.split() for n in first], list(range(len(first)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(names):
        for j in range(i):
            most = max(len(a), len(names[j])) // 5
            if abs(len(a) - len(names[j])) <= most and distance(a, names[j]) <= most:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    seen, gone = set(), {}
    for d, pos, n in order:
        r = find(first[n])
        if r in seen:
            gone.setdefault(d, set()).add(pos)
        seen.add(r)
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, set())) for d, t in docs}


def edited(seed):
    """Pairs of lines at every number of edits that 0.8 allows and one more: words changed, added, dropped, moved lengths."""
    rng, docs = random.Random(seed), []
    for n in (1, 2, 3, 4, 5, 6, 9, 10, 14, 15, 16, 19, 20, 24, 25, 40):
        for edits in range(n // 5 + 2):
            for kind in ("change", "add", "drop"):
                a = [f"w{rng.randrange(400)}" for _ in range(n)]
                b = list(a)
                for k in rng.sample(range(n), min(edits, n - 1)):
                    if kind == "drop":
                        b[k] = None
                    else:
                        b[k] = f"x{rng.randrange(400)}" if kind == "change" else f"{b[k]} y{rng.randrange(400)}"
                docs += [(len(docs), " ".join(a)), (len(docs) + 1, " ".join(w for w in b if w))]
    docs.append((len(docs), "w1  w2\nw1 w2\nw1 w2 w1 w2 w1 w2 w1 w2\nw1 w2 w1 w2 w1 w2 w1"))
    return docs


DOCS = "doc_id long, text string"


@pytest.mark.parametrize("docs", [corpus(0, 40), corpus(1), edited(5)], ids=["corpus0", "corpus1", "edited"])
def test_all_similar_lines_are_linked(spark, docs):
    out = lines.dedup(spark.createDataFrame(docs, DOCS)).collect()
    assert {r.doc_id: r.text_kept for r in out} == links_of_all_pairs(docs)
    assert any(r.n_removed for r in out)
    assert all(r.n_lines == len(r.text.split("\n")) for r in out)


@pytest.mark.parametrize("frequent", [0.0, 1.0])
def test_frequent_blocks_are_like_others(spark, monkeypatch, frequent):
    monkeypatch.setattr(lines, "FREQUENT", frequent)
    docs = corpus(3, 30)
    out = lines.dedup(spark.createDataFrame(docs, DOCS)).collect()
    assert {r.doc_id: r.text_kept for r in out} == links_of_all_pairs(docs)


def test_no_edited_line_is_missed(spark):
    """400 lines each of 12, 20 and 30 words with one word changed, and of 100 with 20 changed."""
    rng, rows = random.Random(2), []
    for n, edits in ((12, 1), (20, 1), (30, 1), (100, 20)):
        for _ in range(400 if n < 100 else 40):
            a = [f"w{rng.randrange(5000)}" for _ in range(n)]
            b = [f"x{rng.randrange(5000)}" if k % (n // edits) == 2 else w for k, w in enumerate(a)]
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    out = lines.dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: r.n_removed for r in out} == {i: i % 2 for i in range(len(rows))}


def test_row_repeated_ten_thousand_times(spark):
    line = " ".join(f"w{i}" for i in range(40))
    rows = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(line).alias("text"))
    more = spark.createDataFrame([(0, "w0 w1 w2 other"), (2, line + " w40"), (None, line)], DOCS)
    out = lines.dedup(rows.union(more)).groupBy("doc_id", "n_removed").count().collect()
    assert {(r.doc_id, r.n_removed, r["count"]) for r in out} == {(1, 0, 100_000), (0, 0, 1), (2, 1, 1), (None, 1, 1)}


def test_one_id_with_two_texts(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e g\nz"), (None, "a b c d e f"), (2, "z")]
    out = lines.dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert sum(r.n_removed for r in out) == 3
    assert {r.n_removed for r in out if r.doc_id in (None, 2)} == {1}


def test_line_of_many_words(spark):
    words = [f"w{i}" for i in range(70_000)]
    other = [*words[:-2], "x", "y"]
    out = lines.dedup(spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:1000]))], DOCS)).collect()
    assert {r.doc_id: r.n_removed for r in out} == {1: 0, 2: 1, 3: 0}


def test_edit_similarity_in_bands(spark):
    rng, rows = random.Random(1), []
    for n in (5, 30, 200, 900, 2500):
        for k in (0, 1, n // 6, n // 5, n // 4, n // 2):
            a = "".join(rng.choice("abcdefgh") for _ in range(n))
            b = list(a)
            for i in rng.sample(range(n), k):
                b[i] = "z"
            rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r.ok for r in df.select(lines.edit_similar(F.col("a"), F.col("b")).alias("ok")).collect()]
    assert got == [distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9) for a, b in rows]


def test_odd_documents(spark, odd_docs):
    docs = odd_docs.withColumnsRenamed({"lang": "n_removed", "source": "text_kept", "n_chars": "size"})
    out = lines.dedup(docs)
    assert out.columns == ["doc_id", "text", "size", "n_lines", "n_removed", "text_kept"]
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == odd_docs.count()
    assert got[1].text_kept is None and got[1].n_lines == 0
    assert got[2].text_kept == "" and got[2].n_lines == 1
    assert got[3].text_kept == got[3].text
    assert got[5].n_removed == 0 and got[6].text_kept == ""
    assert lines.dedup(odd_docs.limit(0)).count() == 0
