import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm.langid import identify, language_model, term_counts

WORDS = {
    "en": "the and of to in that with from this have were they which their would there about could other into".split(),
    "de": "der die und das nicht mit sich auch werden einen über nach wie können für schon haben durch größer straße".split(),
    "fr": "les des une dans pour qui sur avec par plus être cette tout nous était même après très où déjà".split(),
}


def corpus(spark, n=600):
    draw = random.Random(1)
    rows = []
    for i in range(n):
        lang = draw.choice(sorted(WORDS))
        rows.append((i, " ".join(draw.choice(WORDS[lang]) for _ in range(draw.randrange(15, 80))), lang, lang))
    rows += [(n, None, "en", ""), (n + 1, "", "de", ""), (n + 2, "12 34 !?", "fr", ""), (n + 3, "the and of to in that with", None, ""), (None, "der die und das nicht", "de", "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = identify(docs).collect()
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert len(held) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.98
    by = {r.doc_id: r for r in got}
    assert all(by[600 + k].lang_pred == "und" and by[600 + k].score == 0 for k in range(3))
    assert by[603].lang_pred == "en" and by[None].lang_pred == "de" and all(0 <= r.score <= 1 for r in got)


def test_predictions_like_a_dense_model(spark):
    """Scores are the softmax of features times weights, computed without sparse rows; weights are sparse, and probabilities calibrated."""
    docs = corpus(spark)
    model = language_model(docs)
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text]
    got = {r.doc_id: r for r in identify(docs).collect()}
    for i, text in rows[::7]:
        counts = term_counts(text)
        if counts is None:
            continue
        dense = np.where(counts > 0, (1 + np.log(np.maximum(counts, 1))) * model.idf, 0.0)
        dense /= np.linalg.norm(dense)
        z = (dense @ model.weights[:-1] + model.weights[-1]) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i].lang_pred == model.languages[int(np.argmax(p))] and abs(got[i].score - p.max()) < 1e-5
    assert (model.weights == 0).mean() > 0.8 and 0.02 < model.temperature < 20
    assert np.mean([r.score for r in got.values() if r.lang_pred != "und"]) > 0.9


def test_long_and_repeated_rows(spark):
    """A text of megabytes is read to its end, and equal texts are predicted alike."""
    long = "12 " * 300_000 + "der die und das nicht mit sich auch werden " * 20_000
    extra = spark.createDataFrame([(9000, long, None, "")] + [(9001 + i, "les des une dans pour", None, "") for i in range(50)] + [(9001, "les des une dans pour", None, "")], "doc_id bigint, text string, lang string, score string")
    got = [r for r in identify(corpus(spark).unionByName(extra)).collect() if (r.doc_id or 0) >= 9000]
    assert len(got) == 52 and {r.lang_pred for r in got if r.doc_id == 9000} == {"de"} and len({(r.lang_pred, r.score) for r in got if r.doc_id > 9000}) == 1


def test_too_many_labels(spark):
    docs = spark.range(1200).selectExpr("id AS doc_id", "'some words' AS text", "concat('l', id) AS lang")
    with pytest.raises(ValueError, match="no languages"):
        language_model(docs.unionByName(docs.selectExpr("doc_id + 5000 AS doc_id", "text", "concat('m', lang) AS lang")))


def test_labels_and_ids_are_no_inputs(spark):
    docs = corpus(spark, 200)
    changed = docs.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, "zz").otherwise(F.col("lang")))
    assert sorted(map(str, identify(docs).collect())) == sorted(map(str, identify(changed).collect()))


def test_without_rows_or_labels(spark):
    docs = corpus(spark, 20)
    assert identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
