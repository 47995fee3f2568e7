import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_word_ids_equal_the_tokenizers(tok):
    ids = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet="ab Zé.,'\n\t 1|ñß日 s", max_size=60))
    def same(text):
        assert np.frombuffer(ids(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids

    same()


def test_added_tokens_keep_their_ids(tok):
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    ids = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "end", "'s", "é"]), max_size=12).map("".join))
    def same(text):
        assert np.frombuffer(ids(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids

    same()
    assert np.frombuffer(ids("end <|endoftext|> go"), "<u4").tolist() == [437, 220, 50256, 467]


@given(st.lists(st.integers(1, 20), max_size=60))
def test_first_fit_decreasing_equals_a_plain_scan(lengths):
    free, want = [20] * (len(lengths) + 1), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        want[i] = next(b for b in range(len(free)) if free[b] >= lengths[i])
        free[want[i]] -= lengths[i]
    assert packing.first_fit_decreasing(lengths, 20) == want


@given(st.lists(st.integers(1, 15), max_size=60))
def test_filled_keeps_every_id_and_leaves_no_padding(lengths):
    bins = {}
    for i, b in enumerate(packing.first_fit_decreasing(lengths, 16)):
        bins.setdefault(b, []).append([i, 0, lengths[i]])
    out = packing.filled(list(bins.values()), 16)
    cells = sorted((r, s + k) for b in out for r, s, n in b for k in range(n))
    assert cells == [(i, k) for i, n in enumerate(lengths) for k in range(n)]
    assert all((f := sum(p[2] for p in b)) == 16 or f & (f - 1) == 0 for b in out)


def test_pieces_tile_documents_and_sequences(spark, tok):
    long = "alpha beta " * 3000
    rows = [(1, "some words here"), (2, None), (3, ""), (4, long), (5, long), (None, "no id"), (None, "no id"), (1, "some words here")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, sequence_id long")
    got = packing.pack(df, capacity=64).toPandas()
    total = sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert got["length"].sum() == total
    want = np.array(tok.encode(long, add_special_tokens=False).ids + [0], "<u4")
    mine = got[got.doc_id == 4].sort_values("start")
    assert b"".join(mine.ids) == want.tobytes() and (mine.doc_tokens == len(want)).all()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
        f = s.length.sum()
        assert f == 64 or f & (f - 1) == 0
    d = packing.digests(packing.pack(df, capacity=64)).where("doc_id = 4 and start = 0").first()
    assert d.ids_crc32 == zlib.crc32(want[: d.length].tobytes())
    assert packing.pack(df.limit(0)).count() == 0
