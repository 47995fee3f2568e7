import random
import zlib

import numpy as np

from tessera.llm import langid

WORDS = {"en": "the of and to in that is was for with", "de": "der die und das nicht für über schön ist auf", "fr": "le la et été être où que pour dans très"}


def text(lang, r, n=30):
    return " ".join(r.choice(WORDS[lang].split()) for _ in range(n))


def test_counts_equal_a_plain_count():
    g, letter = langid.grams("Ab  1 c")
    assert letter and len(g) == 4 + 5 + 4  # " ab c " has 4 inner characters, 5 pairs and 4 triples
    assert langid.grams("AB c")[0].tolist() == langid.grams("ab, 7c")[0].tolist()
    assert langid.grams("123 ...")[1] is False
    at, n, _ = langid.counted("aaaa")
    assert n.sum() == len(langid.grams("aaaa")[0])


def test_ftrl_with_penalties_is_sparse_and_separates():
    m = langid.Ftrl(2, l1=0.5)
    r = random.Random(1)
    for _ in range(400):
        y = r.randrange(2)
        m.learn(np.array([y, 2 + r.randrange(50)]), np.array([1.0, 1.0]), y)
    w = m.weights(slice(None))
    assert w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 > w[1, 0]
    assert (w[2:52] == 0).mean() > 0.5


def test_temperature_flattens_overconfident_logits():
    z = np.array([[8.0, 0.0]] * 10)
    y = np.array([0] * 7 + [1] * 3)
    assert 5 < langid.temperature(z, y) <= 10


def test_held_out_accuracy_and_edge_cases(spark):
    r = random.Random(3)
    rows = [(i, text(lang := r.choice(list(WORDS)), r), lang if i % 7 else None, 1) for i in range(600)]
    truth = {i: lang for i, _, lang, _ in rows}
    rows += [(1000, None, "en", 1), (1001, "", "de", 1), (1002, "12 34 !", "fr", 1), (1003, text("fr", r, 200_000), "fr", 1), (None, text("de", r), "de", 1), (5, rows[5][1], "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").repartition(3)
    model = langid.fit(df.where(~langid.held_out("doc_id")), per_language=100, shards=2)
    got = langid.predicted(df, model).collect()
    assert len(got) == len(rows) and model.classes == sorted(WORDS)
    by = {g.doc_id: g for g in got}
    for i in truth:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    right = [by[i].lang_pred == lang for i, lang in truth.items() if lang and by[i].held_out]
    assert np.mean(right) > 0.95
    assert all(by[i].lang_pred == "und" for i in (1000, 1001, 1002)) and by[1003].lang_pred == "fr" and by[None].lang_pred == "de"
    assert all(0 <= g.score <= 1 for g in got)
    none = langid.fit(df.limit(0))
    assert {g.lang_pred for g in langid.predicted(df, none).collect()} == {"und"}
    assert langid.predicted(df.limit(0), model).count() == 0
