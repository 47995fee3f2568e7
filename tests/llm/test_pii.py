import hashlib
import random
import re
from itertools import accumulate

from pyspark.sql import functions as F

from tessera.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def brute(text):
    out = []
    for o, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn(digits) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), o, m.end(), kind))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns(spark):
    r = random.Random(5)
    bits = ["a@b.co", "x.y%+-@d-e.f.g_h@i.j", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "000.01.255.256", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (456) 555-2186", "+12 34", "é", "𝄞", " ", "\n", ".", "-", "@", "+", "0", "12345", "word", "4000000000000002", "password=abcdef12", "token = \"be8a8e71\"", ")", "("]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(1500)] + [None, "", "7" * 20000, "a" * 20000, "1." * 9000, "+1" * 9000, "mail me: jo@site.org " * 200]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)] + [(0, texts[0], 9)], "doc_id long, text string, n_email int").repartition(4)
    got = pii.digests(pii.spans(df.select("doc_id", "text"))).collect()
    assert len(got) == len(texts) + 1
    added = 0
    for row in got:
        want = brute(texts[row.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), texts[row.doc_id]
        assert [row[f"n_{k}"] for k in PLAIN] == [sum(x[3] == k for x in want) for k in PLAIN]
        have = row.spans.split(",") if row.spans else []
        assert [x for x in have if x.split(":")[0] in PLAIN] == (joined.split(",") if joined else [])
        added += len(have) - len(want)
    assert added > 0


def test_redaction_keeps_the_rest(spark):
    rows = [(1, "Write to jo@site.org or +1 (456) 555-2186, card 4111 1111 1111 1111.", "x"), (2, None, "x"), (3, "clean words", "x"), (4, "éa 1.2.3.4", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert got == {1: "Write to [EMAIL] or [PHONE], card [CARD].", 2: None, 3: "clean words", 4: "éa [IP]"}
    assert pii.redacted(df.limit(0)).count() == 0 and pii.redacted(df).columns == df.columns


def test_em_trusts_labelers_that_agree():
    counts = {(0, 1, 1, -1, 1, 1): 900, (0, 0, 0, -1, 0, 1): 500, (0, 1, 1, 1, 1, 0): 40, (0, 0, 1, -1, 0, 0): 60}
    _, yes, post = pii.reliabilities(counts)
    assert post[0, 1, 1, -1, 1, 1] > 0.9 and post[0, 0, 0, -1, 0, 1] < 0.1
    assert yes[0, 0, 1] > 0.9 > 0.1 > yes[0, 0, 0]
    w = pii.span_classifier(counts, post)
    z = lambda p: sum(a * b for a, b in zip(w, pii._features(p), strict=True))
    assert z((0, 1, 1, -1, 1, 1)) > 0 > z((0, 0, 0, -1, 0, 1))


def test_secrets_need_no_digit_elsewhere(spark):
    rows = [(0, "password: hunterabc"), (1, "token=abcdefgh here"), (2, "password: hunterabc 7"), (3, "no password here")]
    got = {r.doc_id: [(c.start, c.stop) for c in r.candidates] for r in pii.candidates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: [(0, 19)], 1: [(0, 14)], 2: [(0, 19)], 3: []}


def test_running_values_over_blocks(spark):
    r = random.Random(1)
    rows = [(i, [r.randint(0, 9) for _ in range(n)]) for i, n in enumerate([0, 1, 127, 128, 129, 256, 1000])]
    df = spark.createDataFrame(rows, "i int, x array<int>")
    got = df.select("i", pii.running(F.col("x"), lambda a, b: a + b, 0).alias("s"), pii.running(F.col("x"), F.greatest, 0).alias("m")).collect()
    for i, s, m in got:
        assert s == list(accumulate(rows[i][1])) and m == list(accumulate(rows[i][1], max))


def test_redaction_of_many_spans_and_of_clashing_columns(spark):
    many = "a1@b.co, " * 700 + "password=a@b.cold9 x"
    df = spark.createDataFrame([(1, many, "mine", 2), (1, many, "mine", 2)], "doc_id long, text string, spans string, first int")
    got = pii.redacted(df).collect()
    assert len(got) == 2 and got[0].spans == "mine" and got[0].first == 2
    assert got[0].text.startswith("[EMAIL], " * 700) and "@" not in got[0].text


def test_own_features_reach_the_classifier():
    counts = {(4, -1, 1, 1, 1, 1, 2, 1, 2, 1): 500, (4, -1, 0, 0, 0, 0, 0, 0, 0, 0): 500, (4, -1, 1, -1, 0, 1, 2, 1, 2, 1): 20, (4, -1, 1, -1, 0, 1, 0, 0, 0, 0): 20}
    votes = {}
    for p, n in counts.items():
        votes[p[:6]] = votes.get(p[:6], 0) + n
    _, _, post = pii.reliabilities(votes)
    w = pii.span_classifier(counts, post)
    z = lambda p: sum(a * b for a, b in zip(w, pii._features(p), strict=True))
    assert z((4, -1, 1, -1, 0, 1, 2, 1, 2, 1)) > z((4, -1, 1, -1, 0, 1, 0, 0, 0, 0))
