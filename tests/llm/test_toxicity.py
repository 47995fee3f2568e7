import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import toxicity
from tessera.llm.common import held_out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=3, max_size=8), min_size=1, max_size=8), st.text("abcd", max_size=9), st.integers(0, 2))
def test_automata_equal_edit_distances(terms, word, edits):
    lex = toxicity.Lexicon({t: float(i) for i, t in enumerate(sorted(terms))}, edits=edits, least=3)
    best = min(distance(t, word) for t in terms)
    got = lex.match(word)
    assert got is None if best > edits else got[1] == best == distance(got[0], word)


def test_stems_misspellings_and_short_terms():
    lex = toxicity.Lexicon({"idiot": 3.0, "lowe*": 4.0, "bad": 2.0})
    assert lex.match("idoit") is None and lex.match("idi0t") == ("idiot", 1) and lex.match("idiots") == ("idiot", 1)
    assert lex.match("lowerlich") == ("lowe*", 0) and lex.match("lawerlich") is None and lex.match("bat") is None


def test_quotation_is_told_from_abuse():
    lex = toxicity.Lexicon({"idiot": 3.0})
    abuse, quote = toxicity.features("you are an idiot", lex), toxicity.features('he said "idiot" once', lex)
    assert abuse[1] == 3.0 and abuse[5] == 3.0 and quote[1] == 0 and quote[4] == 3.0


def test_held_out_documents_and_edge_cases(spark):
    r = random.Random(6)
    rows, marks = [], []
    for i in range(900):
        words = ["".join(r.choice("aeioudlnrst") for _ in range(r.randint(2, 8))) for _ in range(30)]
        toxic = i % 8 == 0
        if toxic:
            words[r.randrange(30)] = r.choice(["moronic", "scumbag", "qx" + "yz" + r.choice("abcdefgh") * 3, "moronlc"])
        rows.append((i, " ".join(words), 1))
        marks.append((i, int(toxic), None))
    rows += [(2000, None, 1), (2001, "", 1), (None, "moronic", 1), (2002, "word " * 60_000 + "scumbag", 1), (0, rows[0][1], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3)
    labels = spark.createDataFrame([*marks, (None, 1, None), (3, None, None)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels.where(~held_out("doc_id")))
    assert any(t.startswith("moro") for t in model.terms) and any(t.startswith("qx") and t.endswith("*") for t in model.terms)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(rows)
    by = {g.doc_id: g for g in got}
    held = [(by[i].predicted, t) for i, t, _ in marks if by[i].held_out]
    assert np.mean([p == t for p, t in held]) > 0.97 and all((g.predicted == 1) == (g.score >= 0.3) for g in got)
    assert by[2000].predicted == by[2001].predicted == 0 and by[2002].predicted == by[None].predicted == 1
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not g.predicted for g in got)
    none = toxicity.fit(docs, labels.limit(0))
    assert {g.predicted for g in toxicity.scored(docs, none).collect()} == {0}
    assert toxicity.scored(docs.limit(0), model).count() == 0
