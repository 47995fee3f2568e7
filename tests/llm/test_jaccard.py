import random
import re

import numpy as np

from tessera.llm import jaccard
from tessera.llm.shingles import shingles, word_hashes


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_words_and_shingles_equal_plain_ones():
    r = random.Random(1)
    texts = ["".join(r.choice("aB é\n\t\x0b\xa0,") for _ in range(r.randint(0, 40))) for _ in range(400)]
    seen = {}
    for t in texts:
        w = words_of(t)
        h = word_hashes(t.encode())
        assert len(h) == len(w) and all(seen.setdefault(a, b) == b for a, b in zip(w, h.tolist(), strict=True))
        assert len(shingles(t.encode(), 4)) == len(plain(t, 4))
    assert len(set(seen.values())) == len(seen)


def test_keys_meet_whenever_sets_link():
    r = np.random.default_rng(2)
    pool = r.integers(0, 1 << 63, 400).astype(np.uint64)
    for size in (8, 30, 120, 150):
        for _ in range(60):
            classes = r.integers(0, 4, jaccard.CELLS).astype(np.uint8)
            a = np.unique(r.choice(pool, size, replace=False))
            b = np.unique(np.concatenate([r.choice(a, size - r.integers(0, max(1, size // 10)), replace=False), r.choice(pool, r.integers(0, max(1, size // 10)))]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * len(np.union1d(a, b)):
                (ka, pa), (kb, pb) = (jaccard.index_keys(x, classes, 85) for x in (a, b))
                met = [(i, j) for k in np.intersect1d(ka, kb) for i in pa[ka == k] for j in pb[kb == k]]
                assert any(185 * min(len(a) - i, len(b) - j) >= 85 * (len(a) + len(b)) for i, j in met)


def test_components_equal_brute_force(spark):
    r = random.Random(3)
    rows, vocabulary = [], [f"w{i}" for i in range(300)]
    for base in range(14):
        own = [r.choice(vocabulary) for _ in range(r.choice([6, 20, 60, 200]))]
        for _ in range(r.choice([1, 3, 30])):
            w = list(own)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two"), (905, "one two three"), (3, rows[3][1]), (None, rows[5][1]), (906, "x y " * 30000)]
    r.shuffle(rows)
    docs = spark.createDataFrame([(*x, 1, b"") for x in rows], "doc_id long, text string, n int, node binary").repartition(3)
    sets = [plain(t, 4) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= 85 * (len(sets[i]) + len(sets[j]) - inter):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    want = sorted(((d is None, d or 0), len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows))
    got = sorted(((g.doc_id is None, g.doc_id or 0), g.n_shingles, g.component_id) for g in jaccard.near_duplicates(docs, words=4, share=85).collect())
    assert got == want
    kept = jaccard.one_of_each(docs, words=4, share=85)
    assert kept.columns == docs.columns and {k.doc_id for k in kept.collect()} == {c for _, _, c in want} | {None}
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_adjacent_pairs_meet_in_sets_of_any_size():
    """All shingles frequent, so that every key is a combination."""
    r = np.random.default_rng(4)
    pool = r.integers(0, 1 << 63, 5000).astype(np.uint64)
    classes = np.full(jaccard.CELLS, 5, np.uint8)
    tried = 0
    for size in (2, 3, 5, 9, 40, 300, 1500):
        for share in (70, 80, 85, 95):
            for _ in range(15):
                a = np.unique(r.choice(pool, size, replace=False))
                off = int(r.integers(0, 1 + size * (100 - share) // 100))
                b = np.unique(np.concatenate([r.choice(a, len(a) - off, replace=False), r.choice(pool, int(r.integers(0, 1 + off)))]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= share * len(np.union1d(a, b)):
                    tried += 1
                    ka, kb = (jaccard.index_keys(x, classes, share)[0] for x in (a, b))
                    assert len(np.intersect1d(ka, kb)), (size, share)
                    assert len(ka) <= 3 * len(a)
                    x, y = jaccard.bit_map(a), jaccard.bit_map(b)
                    assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= len(a) + len(b) - 2 * both
    assert tried > 150


def test_a_passage_in_many_unlinked_long_documents_makes_no_pairs(spark):
    r = random.Random(6)
    some = lambda n: [f"w{r.randrange(50_000)}" for _ in range(n)]
    passage = some(120)
    rows = [(i, " ".join(some(150) + passage + some(150))) for i in range(300)]
    near = rows[0][1].split()
    near[5] = "changed"
    rows += [(300, " ".join(near)), (301, " ".join(passage)), (302, " ".join(passage[:-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {g.doc_id: g.component_id for g in jaccard.near_duplicates(docs).collect()}
    assert got == {i: i for i in range(303)} | {300: 0, 302: 301}


def test_one_of_each_goes_by_row(spark):
    t, u = " ".join(f"t{i}" for i in range(50)), " ".join(f"u{i}" for i in range(50))
    rows = [(1, t, "a"), (5, t, "b"), (5, u, "c"), (7, u, "d"), (7, u, "e"), (9, "", "f"), (9, "", "g"), (4, t + " end", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string")
    kept = sorted((k.doc_id, k.text, k._gone) for k in jaccard.one_of_each(docs).collect())
    assert kept == [(1, t, "a"), (5, u, "c"), (9, "", "f"), (9, "", "g")]
    twice = spark.createDataFrame([(3, t, "x"), (3, t, "y")], "row_id long, text string, row_hash string")
    assert jaccard.one_of_each(twice, id_col="row_id").count() == 1
    assert jaccard.one_of_each(docs.limit(0)).count() == 0
