import random
import zlib

from trackloom.llm import langid

WORDS = {"one": "the and of thing inthe ouble".split(), "two": "der die und keit schaft ung".split(), "three": "que ción los para mente".split()}


def corpus(spark, n=240):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        name = list(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[name]) for _ in range(30)), name))
    return spark.createDataFrame([*rows, (9000, None, "one"), (9001, "12 34 !!", "two"), (9002, "the and of the", None), (None, "der die und", "two")], "doc_id long, text string, lang string")


def test_kernel_weights_equal_the_kernel(spark):
    """The multiplied-out weights give the scores of the plain kernel rows."""
    import numpy as np

    texts = ["the and of", "and the thing", "der die und", "und die keit", "que los para"]
    labels = ["one", "one", "two", "two", "three"]
    sets = [langid.grams(t) for t in texts]
    model = langid.fit_sets(sets, labels, landmarks=1)
    k = lambda a, b: len(set(a.tolist()) & set(b.tolist())) / np.sqrt(len(a) * len(b))
    marks = [sets[0], sets[4], sets[2]]  # of labels one, three, two
    K = np.array([[k(s, m) for m in marks] for s in sets])
    M = np.array([[k(a, b) for b in marks] for a in marks])
    y = np.array([[x == n for n in model.labels] for x in labels], float)
    dual = np.linalg.solve(K.T @ K + langid.RIDGE * 5 * M + 5e-9 * np.eye(3), K.T @ y)
    got = model.scores(["the keit los"])
    row = np.array([k(langid.grams("the keit los"), m) for m in marks])
    assert np.allclose(got[0], row @ dual, atol=1e-4)


def test_held_out_accuracy_and_odd_rows(spark):
    docs = corpus(spark)
    out = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(out) == docs.count()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    for i in range(240):
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    held = [i for i in range(240) if out[i].held_out]
    assert sum(out[i].lang_pred == truth[i] for i in held) / len(held) > 0.95
    assert (out[9000].lang_pred, out[9000].score) == ("und", 0.0)
    assert (out[9001].lang_pred, out[9001].score) == ("und", 0.0)
    assert out[9002].lang_pred == "one" and out[None].lang_pred == "two"
    assert all(0 <= r.score <= 1 for r in out.values())


def test_nothing_to_learn(spark, odd_docs):
    assert langid.identify(odd_docs.limit(0)).count() == 0
    from pyspark.sql import functions as F

    blind = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(blind).collect()} == {"und"}
    named = odd_docs.withColumnsRenamed({"source": "score", "n_chars": "lang_pred"})
    assert langid.identify(named).count() == odd_docs.count()
