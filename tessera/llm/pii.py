"""Personal data by weak supervision, in DataFrame operations alone.

Patterns propose spans; labelers (checksums, gazetteers, context words, borders,
shape) vote on each; expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is; and a logistic span classifier is trained
on the resulting posteriors, from the votes and from what no labeler looks at: the span's length, digits, variety of
characters and what follows it. Every span of a base kind that passes its kind's own check stays, and those that fail it teach
the labelers' reliabilities alone; the classifier adds spans of the weaker kinds.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, pick, stored, table

#: Kinds in order; the first four are the base kinds.
KINDS = ["email", "ip", "card", "phone", "secret", "account"]
BASE = 4
LABELERS = ["check", "gazetteer", "context", "border", "shape"]
#: The classifier's own features, each of a few values.
OWN = {"length": 4, "digits": 4, "variety": 3, "follows": 4}
#: Elements of an array that are accumulated one after another.
BLOCK = 128

# A match of one of these begins at the start of a run or where the last match
# ended (\G), and loops are possessive; so they find what the plain patterns
# find, in linear time and without recursion.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key)[\"']?+\s{0,3}[:=]\s{0,3}[\"']?+[A-Za-z0-9_./+-]{6,}+",
    "account": r"(?<![0-9A-Za-z.+@-])[0-9]{9,20}(?![0-9A-Za-z@])",
}
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+", "secret": None, "account": None}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|mil|int|info|biz|io|eu|de|fr|es|it|uk|us|ca|ch|at|be|nl|pt|br|mx|ar|jp|cn|in|ru|pl|se|no|dk|fi)$",
    "ip": r"^(?!0+\.|127\.|255\.)",
    "card": r"^(?:4|5[ -]?[1-5]|2[ -]?[2-7]|3[ -]?[47]|6[ -]?(?:0|5))",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"(?i)^(?:password|passwd|secret|api|token)",
    "account": r"^(?![0]{3})",
}
CONTEXT = {
    "email": r"(?i)mail|contact|write|kontakt|schreib|escrib|correo|courriel|écri",
    "ip": r"(?i)\bip\b|host|server|address|adresse|dirección|serveur",
    "card": r"(?i)card|visa|master|credit|payment|karte|carte|tarjeta|pago",
    "phone": r"(?i)tel|phone|call|mobile|fax|ruf|llam|appel",
    "secret": r"(?i)login|user|auth|access|config|secret|key",
    "account": r"(?i)account|konto|compte|cuenta|iban|number|nummer|numéro|número|\bid\b",
}
SHAPE = {
    "email": r"^[^@]*[A-Za-z][^@]*@",
    "ip": r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$",
    "card": r"^(?:[0-9]{12,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}[ -]?[0-9]*)$",
    "phone": r"[ ().-]",
    "secret": r"[=:].*[0-9]",
    "account": r"^[0-9]{10,18}$",
}
SPAN = "array<struct<start:int,kord:int,stop:int,value:string>>"
CANDIDATE = "array<struct<start:int,kord:int,stop:int,check:int,gazetteer:int,context:int,border:int,shape:int,length:int,digits:int,variety:int,follows:int>>"


def running(values: Column, step, zero: int) -> Column:
    """step() over an array of ints from `zero` on, after each element; in blocks, so that its time grows with the array's length."""
    none, z = F.array().cast("array<int>"), F.lit(zero)

    def within(part: Column, begin: Column) -> Column:
        return F.aggregate(part, F.struct(begin.alias("at"), none.alias("out")), lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(step(acc["at"], x))).alias("out")))["out"]

    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
    part = lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK))
    begins = F.concat(F.array(z), within(F.transform(blocks, lambda b: F.aggregate(part(b), z, lambda acc, x: step(acc, x))), z))
    return F.when(F.size(values) <= BLOCK, within(values, z)).otherwise(F.flatten(F.transform(blocks, lambda b: within(part(b), F.get(begins, b)))))


def _matched(text: Column, kind: str) -> tuple[Column, Column]:
    """All matches, and the lengths of what a split leaves before each."""
    pattern = PATTERNS[kind]
    there = F.contains(text, F.lit(HINT[kind])) if HINT[kind] else text.rlike("[:=]{1}" if kind == "secret" else "[0-9]{1}")
    hits = F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    gaps = F.when(there, F.transform(F.split(text, pattern, -1), F.length)).otherwise(F.array().cast("array<int>"))
    return hits, gaps


def _found(hits: Column, gaps: Column, kind: str) -> Column:
    """All matches with their code point offsets."""
    sizes = F.transform(hits, F.length)
    stops = running(F.zip_with(F.slice(gaps, 1, F.size(hits)), sizes, lambda g, n: g + n), lambda a, x: a + x, 0)
    spans = F.zip_with(hits, stops, lambda v, e: F.struct((e - F.length(v)).alias("start"), F.lit(KINDS.index(kind)).alias("kord"), e.alias("stop"), v.alias("value")))
    return F.when(F.size(hits) > 0, spans).otherwise(F.array().cast(SPAN)).cast(SPAN)


def _checked(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _voted(text: Column, kind: str, x: Column) -> Column:
    """The candidate x with its labelers' votes: 1, 0, or -1 for none."""
    value = x["value"]
    before = F.substring(text, F.greatest(x["start"] - 39, F.lit(1)), F.least(x["start"], F.lit(40)))
    after = F.substring(text, x["stop"] + 1, 1)
    digits, size = F.length(F.regexp_replace(value, "[^0-9]", "")), F.length(value)
    distinct = F.size(F.array_distinct(F.split(F.substring(value, 1, 64), "")))
    border = F.substring(text, x["start"], 1).rlike("[A-Za-z0-9_]") & (x["start"] > 0) | after.rlike("[A-Za-z0-9_]")
    vote = lambda c, no=0: F.when(c, 1).otherwise(no)
    return F.struct(
        x["start"].alias("start"), x["kord"].alias("kord"), x["stop"].alias("stop"),
        (vote(_checked(kind, value)) if kind in KINDS[:BASE] else F.lit(-1)).alias("check"),
        vote(value.rlike(GAZETTEER[kind])).alias("gazetteer"),
        vote(before.rlike(CONTEXT[kind]), -1).alias("context"),
        vote(~border).alias("border"),
        vote(value.rlike(SHAPE[kind])).alias("shape"),
        F.when(size < 8, 0).when(size < 12, 1).when(size < 20, 2).otherwise(3).alias("length"),
        F.when(digits == 0, 0).when(digits * 2 < size, 1).when(digits < size, 2).otherwise(3).alias("digits"),
        F.when(distinct <= 4, 0).when(distinct <= 8, 1).otherwise(2).alias("variety"),
        F.when(after.rlike("^[\n\r]?$"), 0).when(after == " ", 1).when(after.rlike("[\\p{Punct}]"), 2).otherwise(3).alias("follows"),
    )


def _proposed(kind: str):
    """What is a candidate at all: of cards and phones, runs of digits that have about as many; others as they match."""
    count = lambda x: F.length(F.regexp_replace(x["value"], "[^0-9]", ""))
    if kind == "card":
        return lambda x: count(x).between(12, 19)
    if kind == "phone":
        return lambda x: count(x).between(6, 18)
    return lambda x: F.lit(True)


def _passes(kind: str):
    return lambda x: _checked(kind, x["value"])


def _votes(text: Column, kind: str):
    return lambda x: _voted(text, kind, x)


def candidates(docs: DataFrame, text_col: str = "text", into: str = "candidates") -> DataFrame:
    """docs with a column of candidate spans, their labelers' votes and their features; of the weaker kinds those that no base span overlaps."""
    text, old = F.coalesce(F.col(text_col), F.lit("")), docs.columns
    hits, gaps, names = ({k: n for k, n in zip(KINDS, fresh(docs, *[f"{into}_{x}_{k}" for k in KINDS]), strict=True)} for x in "hgs")
    both = {k: _matched(text, k) for k in KINDS}
    out = docs.withColumns({hits[k]: both[k][0] for k in KINDS} | {gaps[k]: both[k][1] for k in KINDS})
    out = out.withColumns({names[k]: F.filter(_found(F.col(hits[k]), F.col(gaps[k]), k), _proposed(k)) for k in KINDS})
    base = F.concat(*[F.filter(F.col(names[k]), _passes(k)) for k in KINDS[:BASE]])
    (passed,) = fresh(out, f"{into}_base")
    out = out.withColumn(passed, base)
    free = lambda x: ~F.exists(F.col(passed), lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"]))
    every = [F.transform(F.col(names[k]) if k in KINDS[:BASE] else F.filter(F.col(names[k]), free), _votes(text, k)) for k in KINDS]
    return out.withColumn(into, F.concat(*every).cast(CANDIDATE)).select(*[c for c in old if c != into], into)


def reliabilities(counts: dict[tuple, int], rounds: int = 40) -> tuple[dict, dict, dict]:
    """Dawid and Skene's expectation-maximisation for a yes or no truth in each kind.

    counts: rows for each (kord, votes...); its size is bounded by the votes there
    can be. Gives priors by kind, P(vote yes | truth) by (kind, labeler, truth),
    and the posterior of each pattern.
    """
    kinds = sorted({p[0] for p in counts})
    prior = {k: 0.7 for k in kinds}
    yes = {(k, j, t): 0.75 if t else 0.25 for k in kinds for j in range(len(LABELERS)) for t in (0, 1)}
    post: dict = {}
    for _ in range(rounds):
        for p in counts:
            odds = math.log(prior[p[0]] / (1 - prior[p[0]]))
            for j, v in enumerate(p[1:]):
                if v >= 0:
                    a, b = yes[p[0], j, 1], yes[p[0], j, 0]
                    odds += math.log(a / b) if v else math.log((1 - a) / (1 - b))
            post[p] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
        for k in kinds:
            own = [(p, n) for p, n in counts.items() if p[0] == k]
            total = sum(n for _, n in own)
            prior[k] = (sum(n * post[p] for p, n in own) + 7) / (total + 10)
            for j in range(len(LABELERS)):
                for t in (0, 1):
                    w = lambda p, n: n * (post[p] if t else 1 - post[p])
                    voted = [(p, w(p, n)) for p, n in own if p[1 + j] >= 0]
                    # smoothed towards labelers that beat chance, which also keeps the truth's two values apart
                    yes[k, j, t] = (sum(x for p, x in voted if p[1 + j]) + (7.5 if t else 2.5)) / (sum(x for _, x in voted) + 10)
    return prior, yes, post


def _features(p: tuple) -> list[float]:
    """Of a pattern (kord, votes..., own features...; these may be left out)."""
    votes, own = p[1 : 1 + len(LABELERS)], p[1 + len(LABELERS) :]
    shape = [float(i < len(own) and own[i] == v) for i, n in enumerate(OWN.values()) for v in range(n)]
    return [1.0, *[float(v == 1) - float(v == 0) for v in votes], *[float(p[0] == k) for k in range(len(KINDS))], *shape]


def span_classifier(counts: dict[tuple, int], post: dict[tuple, float], steps: int = 300, rate: float = 1.0, l2: float = 1e-3) -> list[float]:
    """Weights of a logistic regression on votes, kind and own features, fitted to the posteriors of the votes."""
    if not counts:
        return [0.0] * len(_features((0,)))
    x = np.array([_features(p) for p in counts])
    y = np.array([post[p[: 1 + len(LABELERS)]] for p in counts])
    share = np.array([float(n) for n in counts.values()])
    share /= share.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        z = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= rate * (l2 * w + x.T @ (share * (z - y)))
    return w.tolist()


def classified(rows: DataFrame, at: str = "candidates", threshold: float = 0.5, into: str = "spans") -> DataFrame:
    """rows of candidates() with spans in place of the candidates in column `at`.

    The labelers' reliabilities and the classifier come from all of the rows. These are read
    twice, so they should be a stored table.
    """
    seen = rows.select(F.explode(at).alias("c")).groupBy("c.kord", *[f"c.{n}" for n in (*LABELERS, *OWN)]).count()
    counts = {tuple(r[:-1]): r[-1] for r in seen.collect()}  # at most 6 * 3**5 * 192 rows, whatever the input
    votes: dict[tuple, int] = {}
    for p, n in counts.items():
        votes[p[: 1 + len(LABELERS)]] = votes.get(p[: 1 + len(LABELERS)], 0) + n
    _, _, post = reliabilities(votes)
    w = span_classifier(counts, post)

    def score(c: Column) -> Column:
        n = 1 + len(LABELERS)
        logit = F.element_at(F.array(*[F.lit(w[0] + x) for x in w[n : n + len(KINDS)]]), c["kord"] + 1)
        for j, name in enumerate(LABELERS):
            logit += F.when(c[name] == 1, w[1 + j]).when(c[name] == 0, -w[1 + j]).otherwise(0.0)
        n += len(KINDS)
        for name, size in OWN.items():
            logit += F.element_at(F.array(*[F.lit(x) for x in w[n : n + size]]), c[name] + 1)
            n += size
        return 1 / (1 + F.exp(-logit))

    stays = F.filter(at, lambda c: (c["kord"] >= BASE) | (c["check"] == 1))
    scored = F.transform(stays, lambda c: F.struct(c["start"].alias("start"), c["kord"].alias("kord"), c["stop"].alias("stop"), (c["kord"] < BASE).alias("base"), score(c).alias("score")))
    return rows.withColumn(into, F.array_sort(F.filter(scored, lambda c: c["base"] | (c["score"] >= threshold)))).drop(at)


def spans(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, into: str = "spans") -> DataFrame:
    """docs with a column `into`: array of (start, kord, stop, base, score), by start and then kind.

    Offsets are code points, the end exclusive. Null and empty texts have no
    spans; a table without candidates trains nothing, and an empty one stays empty. Texts are read whole, once, and long
    ones take time in proportion. Equal texts, and so repeated rows, have equal spans. Other columns stay, but for one
    that is named as `into` is.
    """
    (at,) = fresh(docs, "candidates")
    return classified(stored(candidates(docs, text_col, at)), at, threshold, into)


def _joined(found: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda c: F.concat_ws(":", F.element_at(kind, c["kord"] + 1), c["start"], c["stop"])), ",")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of personal data in their text replaced by its kind; null texts stay null, and all other columns as they are.

    Overlapping spans become one, named after the first. Repeated rows stay; an empty table stays empty.
    """
    at = docs.columns.index(text_col)
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text, kind = F.col(f"c{at}"), F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    done = spans(own, f"c{at}")
    done = done.withColumn("reach", running(F.transform("spans", lambda s: s["stop"]), F.greatest, 0))
    first = F.filter("spans", lambda s, i: (i == 0) | (s["start"] >= F.get("reach", i - 1)))
    last = F.filter("reach", lambda r, i: F.coalesce(F.get("spans", i + 1)["start"] >= r, F.lit(True)))
    done = done.withColumns({"first": first, "last": last})
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get("last", i - 1))
    bits = F.transform("first", lambda c, i: F.concat(F.substring(text, begin(i) + 1, c["start"] - begin(i)), F.element_at(kind, c["kord"] + 1)))
    new = F.when(F.size("spans") == 0, text).otherwise(F.concat(F.array_join(bits, ""), F.substring(text, F.element_at("last", -1) + 1, F.length(text))))
    return done.withColumn(f"c{at}", new).select(*own.columns).toDF(*docs.columns)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spans() of all documents as digests; the texts themselves are not stored."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    return digests(classified(stored(candidates(docs).select("doc_id", "candidates"))))


def digests(found: DataFrame) -> DataFrame:
    """Counts of each base kind, of all spans, and the spans as text and as a hash."""
    base = F.filter("spans", lambda c: c["base"])
    count = lambda k: F.size(F.filter("spans", lambda c: c["kord"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS[:BASE]], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
