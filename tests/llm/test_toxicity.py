import numpy as np

from valuetide.llm.toxicity import OrdinalModel, drop_toxic_rows, fit, fit_ordinal, learn, score_toxicity

from .helpers import docs_frame, odd_docs, prose


def sample(n=400):
    texts = [prose(k, 60) + (" vileword nastyness" if k % 4 == 0 else "") + (" grimcase" if k % 8 == 0 else "") for k in range(n)]
    return texts, [k % 4 == 0 for k in range(n)]


def test_thresholds_rise_and_weights_are_shared():
    row, col = np.array([1, 2, 2, 4, 5, 5]), np.array([0, 0, 1, 0, 0, 1])
    weights, cuts = fit_ordinal(row, col, 2, np.array([0, 1, 2, 0, 1, 2]))
    assert cuts[0] < cuts[1] and (weights > 0).all()
    total = np.bincount(row, weights[col], 6)
    above = 1 / (1 + np.exp(cuts[None, :] - total[:, None]))
    assert (above[:, 0] > above[:, 1]).all() and above.sum(1)[2] > above.sum(1)[1] > above.sum(1)[0]


def test_separates(spark):
    texts, flags = sample()
    model = fit(texts, flags)
    assert model.score("x vileword nastyness y")[1] > 0.5 and model.score(prose(999, 5000))[1] < 0.5
    assert model.score("vilewords NASTYNESS!!! grimcase")[0] > model.score("vilewords")[0]
    docs = docs_frame(spark, [(k, t, "en", "a") for k, t in enumerate(texts)] + [(1000 + k, *r[1:]) for k, r in enumerate(odd_docs())])
    labels = spark.createDataFrame([(k, 1, int(f)) for k, f in enumerate(flags)] + [(0, 1, 0), (5, None, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    learned = learn(docs, labels)
    got = {r.doc_id: r for r in score_toxicity(docs, learned).collect()}
    assert all(got[k].toxic == f for k, f in enumerate(flags)) and not any(got[k].toxic for k in got if k >= 1000)
    kept = drop_toxic_rows(docs, learned)
    assert kept.columns == docs.columns and kept.count() == docs.count() - sum(flags)


def test_no_labels(spark):
    docs = docs_frame(spark, odd_docs())
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = learn(docs, empty)
    assert model == OrdinalModel() and not any(r.toxic for r in score_toxicity(docs, model).collect())
    assert score_toxicity(docs.where("false"), model).count() == 0


def test_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = learn(docs, labels.where("doc_id % 2 = 0"))
    rows = score_toxicity(docs, model).withColumnRenamed("toxic", "pred").join(labels.where("doc_id % 2 = 1"), "doc_id").select("pred", "toxic").collect()
    wrong = sum(r.pred and not r.toxic for r in rows)
    found = sum(r.pred and r.toxic == 1 for r in rows)
    # about a tenth of the flagged rows hold no telling word at all: the labels are noisy
    assert wrong <= 0.002 * len(rows) and found >= 0.83 * sum(r.toxic == 1 for r in rows)
