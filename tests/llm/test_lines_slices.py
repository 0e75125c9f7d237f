"""Blocks dealt out in slices give the same groups, with a part of the keys at a time."""

from trackloom.llm import lines


def _docs(spark):
    word = lambda i, j: f"w{(i * 37 + j * 101) % 900}"
    rows = []
    for i in range(60):
        base = [word(i, j) for j in range(12 + i % 20)]
        rows.append((3 * i, " ".join(base)))
        rows.append((3 * i + 1, " ".join(["x", *base[1:]]) + "\nsome very common line of text here"))
        rows.append((3 * i + 2, " ".join([*base[:-2], f"y{i}", base[-1]]) + f"\nsome very common line of text number{i % 7}"))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_slices_give_the_same_groups(spark, monkeypatch):
    docs = _docs(spark)
    rows = lambda: sorted((r.doc_id, r.n_removed, r.text_kept) for r in lines.dedup(docs).collect())
    whole, seen, members = rows(), [], lines._members

    def watched(nodes, frequent, slices=1, slice_=0):
        out = members(nodes, frequent, slices, slice_)
        seen.append((slices, {r.key for r in out.select("key").collect()}))
        return out

    monkeypatch.setattr(lines, "SLICE", 400)
    monkeypatch.setattr(lines, "_members", watched)
    assert rows() == whole and sum(n for _, n, _ in whole) > 100
    assert len(seen) == seen[0][0] > 2
    assert sum(len(k) for _, k in seen) == len(set().union(*(k for _, k in seen)))
