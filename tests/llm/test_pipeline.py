import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")
def test_stages_keep_columns_and_take_effect(spark):
    import corpus_pipeline as cp
    from tessera.llm.common import stored

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in cp.STAGES[:-1]:
        out = stored(stage(spark, docs, DATA))
        assert out.columns == columns and 0 < out.count() <= n, name
        if name != "pii":
            assert out.join(docs, ["doc_id", "text"], "left_semi").count() == out.count()
        else:
            assert out.where("text like '%[EMAIL]%'").count() > 0 and out.count() == n
        docs, n = out, out.count()
    pieces = cp.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_equal_plain_python(spark, tmp_path):
    """Each stage on what the stage before kept, against a version without Spark that shares no code with the operators."""
    import random
    import re
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as cp
    from tessera.llm import toxicity

    r = random.Random(11)
    some = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    items = [some(25) for _ in range(4)]
    rows = []
    for i in range(160):
        w = some(r.randint(20, 80))
        if i % 8 == 3:
            w[5:5] = ["vile" + "xyz"[i % 3]] * 2
        if i % 10 == 7:
            w[4:4] = items[i % 4]
        if i % 6 == 1:
            w[3:3] = [f"mail{i}@site.org", "4111", "1111", "1111", "1111"]
        if i % 9 == 5:
            w = rows[i - 3][1].split()
            w[r.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, rows[2][1]), (203, "end <|endoftext|> here")]
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int("vile" in (t or ""))) for i, t in rows if i < 160], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, out = dict(rows), {}
    frame = docs
    for name, stage in cp.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        out[name] = frame.collect()
        frame = spark.createDataFrame(out[name], frame.schema)
        got = {x.doc_id: getattr(x, "text", None) for x in out[name]}
        if name == "toxicity":
            want = {i: t for i, t in now.items() if "vile" not in (t or "")}
        elif name == "near_duplicates":
            def grams(t):
                w = (t or "").lower().split()
                return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

            sets, group = {i: grams(t) for i, t in now.items()}, {i: i for i in now}
            for _ in now:
                moved = False
                for i in now:
                    for j in now:
                        both = len(sets[i] & sets[j])
                        if both and 100 * both >= 80 * len(sets[i] | sets[j]) and group[i] < group[j]:
                            group[j], moved = group[i], True
                if not moved:
                    break
            want = {i: t for i, t in now.items() if group[i] == i}
        elif name == "decontamination":
            held = lambda t: any(" ".join(w) in t for w in items)
            want = {i: t for i, t in now.items() if not held(t or "")}
        elif name == "pii":
            hide = lambda t: re.sub(r"4111 1111 1111 1111", "[CARD]", re.sub(r"mail\d+@site\.org", "[EMAIL]", t))
            want = {i: None if t is None else hide(t) for i, t in now.items()}
        else:
            tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            for i, t in now.items():
                ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
                pieces = sorted((x for x in out[name] if x.doc_id == i), key=lambda x: x.start)
                assert sum(p.length for p in pieces) == len(ids) == pieces[0].doc_tokens
                assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in pieces)
            by = {}
            for p in out[name]:
                by.setdefault(p.sequence_id, []).append((p.offset, p.length))
            for own in by.values():
                at = 0
                for o, n in sorted(own):
                    assert o == at
                    at += n
                assert at <= 1024 and (at == 1024 or at & at - 1 == 0)
            continue
        assert got == want, name
        now = want
    assert toxicity.WORD.findall("a-b_c") == ["a", "b", "c"]
