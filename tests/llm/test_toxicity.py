import random

import numpy as np

from trackloom.llm import toxicity


def corpus(spark, n=600):
    rng = random.Random(2)
    clean = [f"word{i}" for i in range(80)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            words[7], words[30] = "vileness", rng.choice(["grotesquely", "grotesque"])
        docs.append((i, " ".join(words).capitalize()))
        if i % 2 == 0:
            labels.append((i, int(i % 7 != 0), int(toxic)))
    docs += [(7000, None), (7001, ""), (7002, "Grotesquery! vileness")]
    labels += [(7000, None, 1), (None, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_unlabelled_toxic_documents_are_found(spark):
    docs, labels = corpus(spark)
    out = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert len(out) == docs.count()
    odd = [i for i in range(600) if i % 2]
    assert all(out[i].toxic == (i % 5 == 0) for i in odd)
    assert out[7002].toxic and not out[7000].toxic and not out[7001].toxic
    kept = toxicity.reject(docs.withColumnRenamed("text", "text"), labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r.toxic for r in out.values())


def test_chain_is_fed_out_of_fold(spark):
    """The later model's inputs differ from the fitted probabilities of its own rows, and predictions agree with plain sums."""
    rng = np.random.default_rng(3)
    sets = [sorted(rng.choice(40, 8, replace=False).tolist()) for _ in range(200)]
    y = np.array([[3 in s, (3 in s) and (5 in s)] for s in sets], float)
    model, apart = toxicity.fit_chain(sets, y, ["a", "b"], {i: i for i in range(40)})
    fitted = model.chained(sets)
    assert not np.allclose(apart[:, 0], fitted[:, 0])
    z = [sum(model.weights[1][i] for i in s) + fitted[k, 0] * model.chain[1][0] + model.bias[1] for k, s in enumerate(sets)]
    assert np.allclose(fitted[:, 1], toxicity.sigmoid(np.array(z)))
    assert ((fitted[:, 0] > 0.5) == (y[:, 0] > 0.5)).mean() > 0.95


def test_no_labels_and_empty(spark, odd_docs):
    docs, labels = corpus(spark, 10)
    none = toxicity.classify(docs, labels.limit(0)).collect()
    assert len(none) == 13 and not any(r.toxic for r in none)
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    named = odd_docs.withColumnsRenamed({"lang": "p_toxic", "source": "toxic"})
    kept = toxicity.reject(named, labels)
    assert kept.columns == named.columns and kept.count() == odd_docs.count()


def test_an_id_repeated_often_is_one_row_of_the_sample(spark):
    """The model is that of single rows, as the least text of an id stands for it."""
    from pyspark.sql import functions as F

    docs, labels = corpus(spark, 120)
    many = docs.union(docs.where("doc_id = 10").crossJoin(spark.range(20_000)).select("doc_id", "text"))
    one, two = toxicity.fit(docs, labels), toxicity.fit(many, labels)
    assert one.features == two.features and np.array_equal(one.weights, two.weights) and np.array_equal(one.bias, two.bias)
    assert toxicity.score(many.where(F.col("doc_id") == 10), two).select("p_toxic").distinct().count() == 1


def test_found_of_documents_never_labelled(spark):
    """End to end against the chain fitted by hand on the same sample."""
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels)
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    marked = {}
    for r in labels.where("doc_id is not null and quality is not null").collect():
        low, toxic = marked.get(r.doc_id, (0, 0))
        marked[r.doc_id] = (max(low, int(r.quality == 0)), max(toxic, r.toxic))
    ids = sorted(marked)
    y = np.array([[marked[i][0], marked[i][1], marked[i][0] * marked[i][1]] for i in ids], float)
    names = list(toxicity.CATEGORIES)
    sets = [sorted(model.held(rows[i])) for i in ids]
    plain = toxicity.unfitted(names, model.features)
    fold, apart = np.arange(len(ids)) % toxicity.FOLDS, np.zeros((len(ids), 3))
    for c in range(3):
        used = [[j for j in s if model.weights[c][j] != 0] for s in sets]
        at = lambda pick: toxicity.flat([used[i] for i in pick])
        every = np.arange(len(ids))
        plain.weights[c], plain.chain[c, :c], plain.bias[c] = toxicity.logistic(*at(every), apart[:, :c], y[:, c], len(model.features))
        for f in range(toxicity.FOLDS):
            inside, held = every[fold != f], every[fold == f]
            w, chain, bias = toxicity.logistic(*at(inside), apart[inside, :c], y[inside, c], len(model.features))
            apart[held, c] = [toxicity.sigmoid(w[used[i]].sum() + apart[i, :c] @ chain + bias) for i in held]
    texts = list(rows.values())
    assert np.allclose(model.probabilities(texts), plain.probabilities(texts), atol=1e-6)
