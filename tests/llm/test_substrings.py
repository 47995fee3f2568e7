import hashlib
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import substrings


@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.integers(1, 9))
def test_sliding_argmin(values, w):
    if len(values) >= w:
        x = np.array(values, np.uint64)
        want = [max(i for i in range(s, s + w) if x[i] == x[s : s + w].min()) for s in range(len(x) - w + 1)]
        assert substrings.sliding_argmin(x, w).tolist() == want


@given(st.lists(st.binary(max_size=30) | st.just(b"same prefix " * 3)))
def test_multikey_quicksort(keys):
    assert [keys[i] for i in substrings.multikey_quicksort(keys)] == sorted(keys)


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate([[False], gone, [False]]).astype(int))
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), list(zip(np.flatnonzero(edges > 0).tolist(), np.flatnonzero(edges < 0).tolist(), strict=True)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("run_rows", [20_000, 2])
def test_removal_equals_brute_force(spark, run_rows):
    r = random.Random(7)
    noise = lambda n: "".join(r.choice("abcdé 123") for _ in range(n))
    passages = [noise(n) for n in (150, 395, 401, 420, 700, 2500)]
    texts = [noise(r.randint(0, 300)) + "".join(r.choice(passages)[r.choice([0, 0, 3]) :] + r.choice(["", "e ", noise(40)]) for _ in range(r.randint(0, 3))) for _ in range(60)]
    texts += [None, "", "x" * 399, "y" * 401, "ab" * 900, passages[5], passages[5], "short", "short", passages[4][:400]]
    df = spark.createDataFrame([(i if i != 20 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, node int").repartition(3)
    want = brute(texts, 400)
    for g in substrings.repeated_bytes(df, run_rows=run_rows).collect():
        i = 20 if g.doc_id is None else g.doc_id
        assert (g.n_bytes, [(s.start, s.stop) for s in g.removed], g.kept_sha256) == want[i], i
    assert substrings.repeated_bytes(df.limit(0)).count() == 0


@pytest.mark.parametrize("run_rows", [20_000, 2])
def test_passages_of_other_documents_are_counted(spark, run_rows):
    r = random.Random(8)
    some = lambda n: [r.choice("abcdefghijklmnop") + r.choice(["", "é", "zz"]) for _ in range(n)]
    passages = [some(n) for n in (40, 50, 51, 52, 60, 90, 130)]
    texts = [" ".join(sum((r.choice([passages[r.randrange(7)][r.choice([0, 0, 4]) :], some(30)]) for _ in range(r.randint(0, 4))), some(r.randint(0, 20)))) for _ in range(60)]
    twice, copied, loud = " ".join(some(60)), " ".join(some(70)), " ".join(some(55))
    # repeated within one document alone; copies; too short; other white space; other case; one word over and over
    texts += [None, "", f"{twice} x {twice}", copied, copied, "short", "short", copied.replace(" ", "\n\t"), loud, loud.upper(), "ab " * 100, "ab " * 70]
    shingles = [{tuple(w[k : k + 51]) for w in [(t or "").split()] for k in range(len(w) - 50)} for t in texts]
    want = [sum(any(s in other for j, other in enumerate(shingles) if j != i) for s in own) for i, own in enumerate(shingles)]
    assert want[60:] == [0, 0, 0, 20, 20, 0, 0, 20, 0, 0, 1, 1] and sum(w > 0 for w in want[:60]) > 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {g.doc_id: g.passages for g in substrings.repeated_bytes(df, run_rows=run_rows).collect()} == dict(enumerate(want))
