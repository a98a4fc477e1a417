"""Language and toxicity models: held-out accuracy, defined cases."""

import random

import numpy as np
from corpus_rows import sentence

from kymo.llm import language, toxicity
from pyspark.sql import functions as F


def test_interactions_that_additive_weights_miss():
    """Toxic only where an insult meets a group: neither word alone tells."""
    rnd = random.Random(1)
    features = toxicity.Features()
    texts, labels = [], []
    for _ in range(1500):
        insult, group = rnd.random() < 0.5, rnd.random() < 0.5
        words = [sentence(rnd, 1) for _ in range(8)] + ["insult" if insult else "praise"] + ["group" if group else "nobody"]
        texts.append(" ".join(words))
        labels.append(float(insult == group))
    docs, y = [features.of(t) for t in texts], np.array(labels)
    model = toxicity.fit(docs[:1200], y[:1200], epochs=25)
    assert ((model.scores(docs[1200:]) >= 0.5) == (y[1200:] == 1)).mean() > 0.95


def test_toxicity_by_frame(spark, messy, empty):
    rnd = random.Random(2)
    rows = [(i, sentence(rnd, 30) + (" scumbag" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(0, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, max_rows=250)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(300, 400))
    scored = toxicity.score(messy, model)  # has a column score of its own
    assert scored.columns.count("score") == 1 and scored.count() == messy.count()
    assert scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert {round(r.score, 6) for r in toxicity.score(docs, none).collect()} == {0.5}


def languages():
    rnd = random.Random(3)
    parts = {"aa": ["tho", "ing", "and", "er"], "bb": ["eau", "oi", "ré", "les"], "cc": ["ció", "que", "os", "ña"]}
    rows = []
    for i in range(600):
        lang = rnd.choice(list(parts))
        words = ["".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(2, 60))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_language_held_out(spark, messy, empty):
    rows = languages()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.train(docs.where("doc_id % 3 <> 1"), per_lang=60, landmarks=24)
    got = {r.doc_id: r for r in language.identify(docs.drop("lang"), model).collect()}
    held = [r for r in rows if r[0] % 3 == 1]
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !?"), (4, "q")], "doc_id long, text string")
    out = {r.doc_id: (r.lang_pred, r.lang_score) for r in language.identify(odd, model).collect()}
    assert [out[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and out[4][0] in {"aa", "bb", "cc"}
    assert language.identify(messy, model).where("lang_score < 0 OR lang_score > 1").count() == 0
    assert language.identify(empty, model).count() == 0
    nothing = language.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    one = language.train(docs.where("lang = 'aa'"))
    assert {r.lang_pred for r in language.identify(docs, one).collect()} == {"aa"}


def test_kernel_is_the_blended_spectrum():
    a, b = language.normalised(language.presence(["abc abd", "abc"]))
    assert abs(a @ a - 3) < 1e-5 and 0 < a @ b < 3


def test_training_rows_are_views_of_the_arrow_buffers():
    import pyarrow as pa

    part = pa.array([[9], [1, 2, 3], [], [4]], pa.list_(pa.int32())).slice(1)
    rows = toxicity._lists(part)
    assert [r.tolist() for r in rows] == [[1, 2, 3], [], [4]]
    assert np.shares_memory(rows[0], part.values.to_numpy())
    assert toxicity._lists(part.slice(0, 0)) == []
