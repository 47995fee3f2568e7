import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import decontam


@given(st.lists(st.integers(0, 5), max_size=30), st.lists(st.integers(0, 5), max_size=30))
def test_common_subsequence(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    n, used = decontam.common_subsequence(np.array(a, np.uint64), np.array(b, np.uint64))
    it = iter(b)
    assert n == rows[-1][-1] == used.sum() and all(any(x == y for y in it) for x, u in zip(a, used, strict=True) if u)


def test_basis_spans_the_leading_directions(spark):
    topics = [["t%d_%d" % (k, i) for i in range(8)] for k in range(3)]
    r = random.Random(1)
    docs = spark.createDataFrame([(" ".join(r.choice(topics[k % 3]) for _ in range(20)),) for k in range(120)], "text string").repartition(3)
    idf = decontam.inverse_frequencies(docs)
    m = decontam.latent_basis(docs, idf, 20, 3, rounds=3)
    vec = lambda k: m[decontam.buckets(decontam.word_hashes(" ".join(topics[k]).encode()))].sum(0)
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert cos(vec(0), vec(0)) > 0.99 > 0.3 > max(abs(cos(vec(0), vec(1))), abs(cos(vec(1), vec(2))))


def test_exact_and_reworded_items_are_found_and_clean_texts_left(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 8)))
    vocabulary = [word() for _ in range(900)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [some(r.randint(15, 60)) for _ in range(30)]
    rows, want = [], set()
    for i in range(200):
        w = some(r.randint(5, 400))
        if i % 4 == 0:
            k = r.randrange(30)
            leak = list(items[k])
            if i % 8 == 0:  # every sixth word replaced
                leak = [x if j % 6 else r.choice(vocabulary) for j, x in enumerate(leak)]
            at = r.randint(0, len(w))
            w[at:at] = leak
            want.add((i, k))
        rows.append((i, " ".join(w), "x"))
    rows += [(500, None, "x"), (501, "", "x"), (502, " ".join(some(50_000) + items[3]), "x"), (None, " ".join(items[4]), "x"), (0, rows[0][1], "x")]
    want |= {(502, 3), (None, 4)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(w), 1) for k, w in enumerate(items)] + [(98, None, 1), (99, "", 1)], "item_id long, text string, cosine int")
    found = decontam.leaks(docs, bench).collect()
    pairs = {(f.doc_id, f.item_id) for f in found}
    assert len(want & pairs) >= 0.9 * len(want) and not pairs - want
    kept = decontam.without_leaks(docs, bench)
    ids = [k.doc_id for k in kept.collect()]
    assert kept.columns == docs.columns and sorted(i for i in ids if i is not None) == sorted({x[0] for x in rows if x[0] is not None} - {d for d, _ in pairs})
    assert decontam.leaks(docs.limit(0), bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0


def test_copies_of_many_items_are_found(spark):
    r = random.Random(5)
    some = lambda n: [f"w{r.randrange(r.choice([100, 20_000]))}" for _ in range(n)]
    items = [some(r.randint(15, 55)) for _ in range(3000)]
    rows, want = [], set()
    for k in range(0, 3000, 10):
        w = some(r.randint(20, 300))
        at = r.randint(0, len(w))
        w[at:at] = items[k]
        rows.append((k, " ".join(w)))
        want.add((k, k))
    docs = spark.createDataFrame(rows + [(10_000 + i, " ".join(some(200))) for i in range(1000)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    found = {(f.doc_id, f.item_id) for f in decontam.leaks(docs, bench).collect()}
    assert len(want & found) >= 0.99 * len(want)


def test_verbatim_items_of_frequent_words_are_found_at_all_sizes(spark):
    r = random.Random(7)
    common = [f"c{i}" for i in range(12)]
    some = lambda n: [r.choice(common) if r.random() < 0.5 else f"w{r.randrange(50_000)}" for _ in range(n)]
    items = {0: [common[i] for i in (3, 1, 4, 0, 5, 9, 2, 6, 8, 7)], 1: [common[i] for i in (7, 2, 0, 8, 1, 8)] + ["only"], 2: ["unique"]}
    for n in (300, 1500):
        rows = [(i, some(r.randint(60, 150))) for i in range(n)]
        for k, item in items.items():
            rows[50 + k][1][20:20] = item
        docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
        bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
        found = {(f.doc_id, f.item_id) for f in decontam.leaks(docs, bench).where("common = 1").collect()}
        assert found == {(50 + k, k) for k in items}


def test_words_weigh_by_the_passages_they_stand_in(spark):
    rows = [(" ".join(f"v{(i * 31 + j) % 5000}" for j in range(4000)),) for i in range(1000, 1040)]
    idf = decontam.inverse_frequencies(spark.createDataFrame(rows, "text string"))
    weights = idf[decontam.buckets(decontam.word_hashes(" ".join(f"v{j}" for j in range(5000)).encode()))]
    assert (idf > 0).all() and np.median(weights) > 1.5


def test_an_item_in_a_fifth_of_the_documents_is_found_in_each(spark):
    r = random.Random(8)
    some = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    item = some(30)
    rows = [(i, some(40) + (item if i % 5 == 0 else []) + some(40)) for i in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(some(25)))], "item_id long, text string")
    assert {(f.doc_id, f.item_id) for f in decontam.leaks(docs, bench).collect()} == {(i, 1) for i in range(0, 3000, 5)}


def test_pairs_equal_a_search_of_all_passages(spark):
    """Against every passage of every document by plain dynamic programming, without vectors: recall of pairs at least 0.9, and none beside."""
    r = random.Random(9)
    some = lambda n: [f"w{int(600 * r.random() ** 1.5)}" for _ in range(n)]
    items = [some(r.randint(12, 40)) for _ in range(12)]
    rows = []
    for i in range(120):
        w = some(r.randint(30, 150))
        if i % 2:
            leak = [x if r.random() > r.choice([0.1, 0.3, 0.45]) else f"n{r.randrange(500)}" for x in r.choice(items)]
            w[10:10] = leak
        rows.append((i, w))

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            left = 0
            for j, y in enumerate(b):
                left, row[j + 1] = row[j + 1], left + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    want = set()
    for i, w in rows:
        for k, item in enumerate(items):
            n, tail = len(item), item[-8:]
            for s in decontam.passages(np.arange(len(w)), 32).tolist():
                near = w[max(0, s - n) : s + 32 + n]
                if lcs(item, near) >= 0.65 * n and lcs(tail, near) >= 4:
                    want.add((i, k))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    found = decontam.leaks(docs, bench, most_items=5).collect()
    close = {(f.doc_id, f.item_id) for f in found}
    assert len(want) > 20 and len(want & close) >= 0.9 * len(want)
    for f in found:
        item, w = items[f.item_id], rows[f.doc_id][1]
        assert lcs(item, w) >= 0.5 * len(item)


def test_stage_takes_columns_of_any_names(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", 3, "x"), (1, "other words here", 4, "y"), (2, None, 5, "z"), (1, "one two three four five six", 6, "x")], "doc_id long, text string, row_hash int, _id string")
    bench = spark.createDataFrame([(7, "one two three four five six")], "item_id long, text string")
    kept = decontam.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(k.row_hash for k in kept.collect()) == [4, 5]


def test_whole_items_are_found_through_the_latent_space_alone(spark, monkeypatch):
    r = random.Random(12)
    some = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    items = [some(r.randint(14, 60)) for _ in range(60)]
    rows = [(i, some(r.randint(0, 60)) + (items[i % 60] if i < 240 else []) + some(r.randint(0, 60))) for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    basis, seen = decontam.latent_basis, []

    def noted(sample, idf, size, rank, *args, **named):
        n = [len(decontam.passages(np.zeros(len(t.text.split())), size)) for t in sample.collect()]
        seen.append((sum(n) + sum(x > 1 for x in n), rank))
        return basis(sample, idf, size, rank, *args, **named)

    monkeypatch.setattr(decontam, "latent_basis", noted)
    found = decontam.leaks(docs, bench, rank=16).collect()
    assert {(f.doc_id, f.item_id) for f in found} == {(i, i % 60) for i in range(240)} and all(f.common == 1 for f in found)
    assert any(rank < n for n, rank in seen)  # a space of fewer directions than it has passages
    monkeypatch.setattr(decontam, "latent_basis", lambda sample, idf, size, rank, *args, **named: np.zeros((len(idf), rank), np.float32))
    assert decontam.leaks(docs, bench, rank=16).count() == 0
