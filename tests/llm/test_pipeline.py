"""The pipeline, stage by stage, against plain versions on a small corpus."""

import random
from collections import Counter

import pytest
from test_lines import links_of_all_pairs
from test_simhash import plain_components, plain_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from trackloom.llm import bpe, mixing, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    words = [a + b for a in ("ble", "ing", "the", "ou", "er", "sh") for b in ("on", "an", "ti", "re", "ly", "st", "nd", "ea")]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    common = [sentence(30) for _ in range(4)]
    docs, labels = [], []
    for i in range(120):
        text = "\n".join([sentence(rng.randrange(8, 40)) for _ in range(rng.randrange(1, 4))] + ([rng.choice(common)] if i % 3 else []))
        if i % 6 == 5:
            text = text.replace(" ", " vileness ", 1) + " grotesque"
        if i % 10 == 7:
            text = docs[-1][1]
        docs.append((i, text, "en", f"s{i % 4}" if i % 11 else None, len(text)))
        if i < 90:
            labels.append((i, 1, int("vileness" in text)))
    docs += [(500, None, None, "s1", None), (501, "", "en", "s1", 0), (502, " \n ", "en", None, 3), (503, common[0], "en", "s2", 1), (503, common[0], "en", "s2", 1)]
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "mix", "bpe"]

    clean = stages["toxicity"](spark, docs, folder).cache()
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = docs.collect()
    p = model.probabilities([r.text or "" for r in rows])[:, list(model.names).index("toxic")]
    want = Counter(tuple(r) for r, x in zip(rows, p, strict=True) if x < toxicity.THRESHOLD)
    assert Counter(map(tuple, clean.collect())) == want
    assert not any("vileness" in (r.text or "") for r in clean.collect())
    assert sum("vileness" not in (r.text or "") for r in rows) == clean.count()

    kept = stages["line_dedup"](spark, clean, folder).cache()
    plain = links_of_all_pairs([(r.doc_id, r.text) for r in clean.where("text is not null").collect()])
    texts = {r.doc_id: r.text for r in kept.collect()}
    plain |= {r.doc_id: None for r in clean.collect() if r.text is None}
    assert texts == {d: t for d, t in plain.items() if t is None or t.strip() or not (dict((r.doc_id, r.text) for r in clean.collect())[d] or "").strip()}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept.collect())

    single = stages["near_dedup"](spark, kept, folder).cache()
    rows = sorted({(r.doc_id, r.text) for r in kept.collect()}, key=lambda r: r[0])
    groups = plain_components([plain_fingerprint(t) for _, t in rows])
    least = {}
    for (d, _), g in zip(rows, groups, strict=True):
        least[g] = min(least.get(g, d), d)
    assert sorted(r.doc_id for r in single.collect()) == sorted(least.values())

    mixed = stages["mix"](spark, single, folder).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(single).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({d: n for d, n in copies.items() if n})
    for name in ("toxicity", "line_dedup", "near_dedup", "mix"):
        assert {"toxicity": clean, "line_dedup": kept, "near_dedup": single, "mix": mixed}[name].columns == corpus_pipeline.COLUMNS

    library = Tokenizer.from_file(bpe.default_path())
    text = {r.doc_id: r.text for r in mixed.collect()}
    for r in stages["bpe"](spark, mixed, folder).collect():
        ids = library.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_run_is_the_stages_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    want = Counter((r.doc_id, r.n_tokens) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, folder).collect()) == want
