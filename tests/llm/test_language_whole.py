"""The language model and its limits take every labelled document."""

import numpy as np

from cliploom.llm import language


def test_every_labelled_document_teaches(spark):
    docs = spark.range(9000).selectExpr("id AS doc_id", "'abc abc' AS text", "'aa' AS lang")
    one = spark.range(1).selectExpr("-1L AS doc_id", "'xyz' AS text", "'aa' AS lang")
    plain, more = language.train(docs), language.train(docs.unionByName(one))
    counts = lambda m: np.exp(m.table[:, 0].astype(float))
    size = 9000 * 2 * len(language._grams(["abc"])[0]) + (1 << language.BUCKETS_LOG2) * language.SMOOTHING
    assert abs(counts(plain).min() * size / language.SMOOTHING - 1) < 0.001
    assert (more.table != plain.table).any()


def test_limits_rest_on_every_labelled_document(spark):
    rows = spark.range(9000).selectExpr("id AS doc_id", "CASE WHEN id < 120 THEN 'qqq www' ELSE 'abc bcd' END AS text", "'aa' AS lang")
    model = language.train(rows)
    worst, usual = (language.judged_texts([t], model)[0][4] for t in ("qqq www", "abc bcd"))
    limit = language.evidence_limits(rows, model)["aa"]
    want = usual - language.SPREADS * max(usual - worst, language.LEAST_SPREAD)
    assert abs(limit - want) < 0.01
