import random

import numpy as np
from pyspark.sql import functions as F
from tidemark.llm import langid
from tidemark.llm.queries import queries


def test_held_out_accuracy_on_the_table(spark):
    got = queries()["op1_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(got) == len(docs)
    held = both[both.held_out]
    assert 150 < len(held) < 350
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def make(n, seed):
    rng = random.Random(seed)
    sound = {"en": "the wash ing with", "de": "und der ung sch", "nl": "het een ijk aar", "fr": "que les eau ais", "es": "los cion ado que", "xx": "zyx qqq vvv"}
    return [(i, lang, " ".join(rng.choice(sound[lang].split()) + rng.choice("aeiou") for _ in range(30))) for i, lang in enumerate(rng.choice(list(sound)) for _ in range(n))]


def test_families_and_pairs(spark):
    df = spark.createDataFrame(make(500, 1), "doc_id long, lang string, text string")
    model = langid.learn(df)
    assert model.families == ["germanic", "other", "romance"]
    assert len(model.pairs["germanic"][0]) == 3
    test = spark.createDataFrame(make(200, 2), "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in langid.identify(test, model).collect()}
    assert sum(got[i].lang_pred == lang for i, lang, _ in make(200, 2)) > 195
    assert all(r.family == {"xx": "other", "fr": "romance", "es": "romance"}.get(r.lang_pred, "germanic") for r in got.values())


def test_edges(spark):
    df = spark.createDataFrame([(1, "en", "the and with of", 9.0), (2, "fr", "que les eau", 9.0), (3, None, "x", 9.0), (4, "en", None, 9.0)], "doc_id long, lang string, text string, score double")
    model = langid.learn(df)
    odd = spark.createDataFrame([(None, "the", 1.0), (5, None, 1.0), (5, None, 1.0), (6, "", 1.0), (7, "123 $$ ...", 1.0), (8, "the " * 500_000, 1.0)], "doc_id long, text string, score double")
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.lang_pred, r.score) for r in langid.identify(odd, model).collect())
    assert [g[1] for g in got] == ["und", "und", "und", "und", "en", "en"]
    assert sum(g[2] for g in got[:4]) == 0
    assert langid.identify(odd.limit(0), model).count() == 0
    nothing = langid.learn(df.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    one = langid.learn(df.where("lang = 'en'"))
    assert langid.identify(odd.where("doc_id = 8"), one).first().lang_pred == "en"
    assert sorted(r.doc_id or 0 for r in langid.accepted(odd, model).collect()) == [0, 8]


def test_sample_is_bounded_and_stable(spark):
    df = spark.createDataFrame(make(400, 3), "doc_id long, lang string, text string")
    a = langid.learn(df, per_lang=10, at_most=45)
    b = langid.learn(df.repartition(5).orderBy(F.rand(1)), per_lang=10, at_most=45)
    assert abs(a.family_w - b.family_w).max() < 1e-12


def test_repeated_ids_and_floor_of_the_score(spark):
    rows = [(i % 40, lang, text) for i, lang, text in make(400, 4)] + [(None, "en", "the wash")] * 5
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    a = langid.learn(df, per_lang=10, at_most=30)
    b = langid.learn(df.repartition(7).orderBy(F.rand(2)), per_lang=10, at_most=30)
    assert abs(a.family_w - b.family_w).max() < 1e-12
    one = langid.learn(spark.createDataFrame(make(400, 5), "doc_id long, lang string, text string"))
    text = make(20, 6)
    sure = {r.doc_id: r.score for r in langid.identify(spark.createDataFrame([(i, t) for i, _, t in text], "doc_id long, text string"), one).collect()}
    floor = sorted(sure.values())[10]
    kept = langid.accepted(spark.createDataFrame([(i, t) for i, _, t in text], "doc_id long, text string"), one, min_score=floor).collect()
    assert {r.doc_id for r in kept} == {i for i, v in sure.items() if v >= floor}


def test_rows_without_an_id_take_no_place(spark):
    def text(lang, k):
        return ("der hund und die katze im haus nummer " if lang == "de" else "the dog and the cat in the house number ") + chr(97 + k % 26) * (1 + k % 7)

    rows = [(k, text("de", k), "de") for k in range(30)] + [(100 + k, text("en", k), "en") for k in range(30)] + [(None, text("en", k), "en") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert model.langs == langid.learn(docs.where("doc_id is not null")).langs and model.predict("the dog")[0] == "en" and model.predict("der hund")[0] == "de"


def test_one_id_and_equal_rows_share_the_sample(spark, monkeypatch):
    """A language of one id alone, and rows that repeat by the thousand, leave room for the others."""
    seen = []
    monkeypatch.setattr(langid, "Model", lambda labels, x: seen.append(sorted(labels)) or labels)
    rows = [(7, f"ein haus {k}", "de") for k in range(40)] + [(1, "the house", "en")] * 3000 + [(k, f"a house {k}", "en") for k in range(2, 30)] + [(7, "one more house", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    langid.learn(docs, per_lang=50)
    langid.learn(docs.repartition(2), per_lang=50)
    assert seen[0] == seen[1] and seen[0].count("de") == 40 and 0 < seen[0].count("en") <= 30
    langid.learn(docs, per_lang=50, at_most=20)
    assert len(seen[2]) == 20


def test_predictions_of_a_small_fit_by_hand(spark):
    texts = ["la casa blanca", "el perro negro", "das haus", "der hund", "the house", "a dog runs"]
    labels = ["es", "es", "de", "de", "en", "en"]
    x = np.array([langid.features(t) for t in texts])
    model = langid.Model(labels, x)
    for t in texts:
        v = langid.features(t)
        family = max(range(len(model.families)), key=lambda k: float(model.family_w[k] @ v)) if len(model.families) > 1 else 0
        langs = model.langs[model.families[family]]
        votes = dict.fromkeys(langs, 0)
        if len(langs) > 1:
            for (i, j), w in zip(*model.pairs[model.families[family]]):
                votes[langs[i] if float(w @ v) > 0 else langs[j]] += 1
        assert model.predict(t)[0] == max(votes, key=votes.get) and model.predict(t)[2] == model.families[family]
    assert [model.predict(t)[0] for t in texts] == labels
