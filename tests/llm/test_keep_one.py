"""One row of each component stays, whatever the ids."""

import random

from trackloom.llm import simhash


def test_null_ids_and_ids_of_several_texts(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(12)]
    # Six unlike texts without id, two unlike texts under one id, a copy of each of them under other ids, repeated rows.
    rows = [(None, t) for t in texts[:6]] * 2 + [(7, texts[6]), (7, texts[7]), (3, texts[7]), (9, texts[6]), (7, texts[6]), (None, texts[8]), (8, texts[8])]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(None, t) for t in texts[:6]] + [(7, texts[6]), (3, texts[7]), (8, texts[8])]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, want))
