import random

from tessera.llm import lines


def test_units_equal_brute_force(spark):
    r = random.Random(4)
    pool = [" ".join(r.choice("alpha Beta gamma delta eps zeta".split()) for _ in range(r.randint(1, 12))) + r.choice([".", "!", ""]) for _ in range(25)]
    rows = [(i, "".join(r.choice(pool) + r.choice([" ", "\n", "  "]) for _ in range(r.randint(0, 8))), "x") for i in range(150)] + [(200, None, "x"), (201, "", "x"), (None, pool[0] * 3, "x")]
    rows += [rows[3], (202, rows[3][1].upper(), "x"), (203, (pool[1] + "\n") * 3000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3)
    first = {}
    key = lambda d: -1 if d is None else d
    distinct = {(d, t) for d, t, _ in rows}
    for d, t in distinct:
        for start, _, digest in lines.units(t or "", 3, 8):
            first[digest] = min(first.get(digest, (1 << 60, 0)), (key(d), start))
    got = lines.repeated(df).collect()
    assert len(got) == len(rows)
    texts = {d: t for d, t, _ in rows}
    for g in got:
        t = texts[g.doc_id] or ""
        own = lines.units(t, 3, 8)
        gone = {i for s, e, dg in own if first[dg] != (key(g.doc_id), s) for i in range(s, e)}
        assert {i for s in g.removed for i in range(s.start, s.stop)} == gone and g.n_units == len(own)
        assert all(a.stop < b.start for a, b in zip(g.removed, g.removed[1:], strict=False))
    clean = {c.doc_id: c.text for c in lines.cleaned(df).collect()}
    assert clean[203].strip() in ("", pool[1]) and clean[200] is None and len(lines.cleaned(df).columns) == 3
    assert lines.repeated(df.limit(0)).count() == 0


def test_passages_of_short_sentences_go_between_different_neighbours(spark):
    r = random.Random(6)
    sentence = lambda n: " ".join("".join(r.choice("aeiounrst") for _ in range(7)) for _ in range(n)) + "."
    for sizes in ([5] * 12, [3, 2, 6, 7, 4, 1] * 3, [2, *[9] * 6, 3]):
        passage = " ".join(sentence(n) for n in sizes)
        around = [(sentence(4), sentence(9), sentence(2)) for _ in range(3)]
        rows = [(i, f"{a} {b} {passage} {c}") for i, (a, b, c) in enumerate(around)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        clean = {c.doc_id: c.text for c in lines.cleaned(docs).collect()}
        assert clean[0] == rows[0][1]
        assert all(clean[i].split() == f"{a} {b} {c}".split() for i, (a, b, c) in enumerate(around) if i)


def test_cleaned_texts_repeat_no_line_and_lose_nothing_unique(spark):
    """Against plain text handling that shares nothing with the operator."""
    r = random.Random(4)
    shared = ["Terms of use apply here.", "one two three four five six seven eight nine", "a b", "UPPER  case line   here"]
    rows = []
    for i in range(40):
        own = [f"only document {i} has line {j} of these." for j in range(3)]
        parts = own + [r.choice(shared) for _ in range(3)]
        r.shuffle(parts)
        rows.append((i, "\n".join(parts), "x"))
    docs = spark.createDataFrame([*rows, (100, None, "x"), (101, "", "x"), (5, rows[5][1], "x")], "doc_id long, text string, _id string").repartition(3)
    out = lines.cleaned(docs)
    assert out.columns == docs.columns and out.count() == 43
    got = {x.doc_id: x.text for x in out.collect()}
    norm = lambda line: " ".join(line.lower().split())
    seen = {}
    for i in range(40):
        for line in got[i].split("\n"):
            if len(line.split()) >= 3:
                assert seen.setdefault(norm(line), i) == i and line in rows[i][1]
    first = {}
    for i, text, _ in rows:
        for line in text.split("\n"):
            first.setdefault(norm(line), i)
    for line, i in first.items():
        assert line in [norm(x) for x in got[i].split("\n")] or len(line.split()) < 3
    assert got[100] is None and got[101] == ""
