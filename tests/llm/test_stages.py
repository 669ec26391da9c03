"""The quality classifier, and the pipeline's stages for quality, lines and mixing, against plain versions; edges of every stage."""

import math
import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_lines import plain as plain_lines

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


# The classifier by loops over documents.


def says(text):
    """Nine votes on a text, by regular expressions: 1 good, 0 bad, 2 nothing."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", text)
    n = len(words)
    if n < 12:
        return "2" * 9
    size = sum(map(len, words))
    upper, lower = len(re.findall(rb"[A-Z]", text)), len(re.findall(rb"[a-z]", text))
    symbol = rb"[#$%&*|~^<>{}\[\]\\/=_@+]"
    three = lambda x, good, bad: "1" if x <= good else "0" if x >= bad else "2"
    stops = sum(w[-1:] in (b".", b"?", b"!") for w in words) / n
    return "".join([
        three(len(re.findall(symbol, text)) / size, 0.01, 0.08), three(upper / max(1, upper + lower), 0.12, 0.4), three(text.count(b"!") / n, 0.05, 0.4), three(sum(w == b"|" for w in words) / n, 0.01, 0.15),
        three(sum(bool(re.fullmatch(symbol, w[-1:])) for w in words) / n, 0.03, 0.3), three(sum(a == b for a, b in zip(words, words[1:])) / n, 0.1, 0.3), three(1 - len(set(words)) / n, 0.7, 0.8),
        "2" if n < 20 else "1" if 0.02 <= stops <= 0.35 else "0", three(size / n, 9.0, 14.0),
    ])


def labels_of(docs):
    """The probability that each document is good, by EM over documents."""
    cast = [says(t) for t in docs]
    share, right = 0.8, [[[0.2, 0.8] for _ in range(9)], [[0.003, 0.997] for _ in range(9)]]

    def good(votes):
        odds = math.log(share / (1 - share)) + sum(math.log(right[1][j][int(v)] / right[0][j][int(v)]) for j, v in enumerate(votes) if v != "2")
        return 1 / (1 + math.exp(-min(max(odds, -60), 60)))

    for _ in range(60):
        p = [good(v) for v in cast]
        share = min(max(sum(p) / len(p), 0.05), 0.98)
        fresh = [[[0.0, 0.0] for _ in range(9)] for _ in range(2)]
        for k, prior in enumerate(((0.2, 0.8), (0.003, 0.997))):
            for j in range(9):
                seen = [(1 + 0.05 * len(cast)) * x for x in prior]
                for v, x in zip(cast, p, strict=True):
                    if v[j] != "2":
                        seen[int(v[j])] += x if k else 1 - x
                fresh[k][j] = [x / sum(seen) for x in seen]
        right = fresh
    return [good(v) for v in cast]


def shape(word):
    kinds = "".join("A" if 65 <= c <= 90 else "a" if 97 <= c <= 122 or c >= 128 else "0" if 48 <= c <= 57 else chr(c) for c in word)
    return re.sub(r"(.)\1+", r"\1", kinds, flags=re.DOTALL).encode("latin-1")


def scores_of(docs, labels):
    """Scores by a logistic scorer on all documents, one weight at a time."""
    bags = []
    for t in docs:
        words = t.split()
        bag = Counter()
        for w in words:
            bag[xxhash.xxh3_64_intdigest(w.lower()) % 2**18] += 1
            bag[xxhash.xxh3_64_intdigest(b"\0" + shape(w)) % 2**18] += 1
        bag[0] += 2 * sum(a == b for a, b in zip(words, words[1:]))
        bags.append({k: float(np.float32(n / len(words))) for k, n in bag.items() if n})
    weight, bias, m, v = defaultdict(float), 0.0, defaultdict(float), defaultdict(float)
    every = sorted(set().union(*bags))
    for k in range(1, 81):
        slope, lean = defaultdict(float), 0.0
        for bag, want in zip(bags, labels, strict=True):
            off = 1 / (1 + math.exp(-(sum(weight[f] * x for f, x in bag.items()) + bias))) - want
            lean += off
            for f, x in bag.items():
                slope[f] += off * x
        for f in [*every, "bias"]:
            g = (lean if f == "bias" else slope[f]) / len(bags) + (0 if f == "bias" else 1e-6 * weight[f])
            m[f], v[f] = 0.9 * m[f] + 0.1 * g, 0.99 * v[f] + 0.01 * g * g
            step = 0.3 * (m[f] / (1 - 0.9**k)) / (math.sqrt(v[f] / (1 - 0.99**k)) + 1e-6)
            if f == "bias":
                bias -= step
            else:
                weight[f] = float(np.float32(weight[f] - step))
    return [1 / (1 + math.exp(-(sum(weight[f] * x for f, x in bag.items()) + bias))) for bag in bags]


def sample():
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in duckdb.sql(f"SELECT * FROM '{DATA}/documents.parquet' ORDER BY doc_id").df().to_dict("records")]
    return [d for d in docs if d[1] and len(d[1]) < 4000][:110]


@here
def test_classifier_by_loops(spark):
    from hyetos.llm.quality import quality

    docs = sample()
    texts = [t.encode() for _, t, *_ in docs if t.split()]
    labels = labels_of(texts)
    scores = scores_of(texts, labels)
    got = {r.doc_id: r for r in quality(spark.createDataFrame(docs, COLUMNS)).collect()}
    for (i, t, *_), label, score in zip([d for d in docs if d[1].split()], labels, scores, strict=True):
        assert got[i].weak_label == pytest.approx(label, abs=1e-9) and got[i].quality_score == pytest.approx(score, abs=2e-3) and got[i].kept == (got[i].quality_score >= 0.5), t[:60]
    assert min(labels) < 0.1 and max(labels) > 0.9 and 0 < sum(r.kept for r in got.values()) < len(docs)


@here
def test_stages_against_plain_versions(spark, tmp_path):
    import corpus_pipeline as C
    from hyetos.llm.mixing import ORACLE

    docs = sample()
    table = spark.createDataFrame(docs, COLUMNS)
    texts = [t.encode() for _, t, *_ in docs]
    scores = scores_of(texts, labels_of(texts))
    sure = [(d[0], s) for d, s in zip(docs, scores, strict=True) if abs(s - 0.5) > 0.01]
    kept = {r.doc_id for r in C.quality_stage(spark, table, DATA).collect()}
    assert len(sure) > 100 and {i for i, _ in sure if i in kept} == {i for i, s in sure if s > 0.5}
    # Lines that all twenty sites share, in front of the sample's own.
    common = "one and the same notice on all pages of all sites there are"
    noted = [(i, f"{common}\n{t}" if k % 2 else t, lang, f"s{k % 30}", n) for k, (i, t, lang, _, n) in enumerate(docs)]
    got = {r.doc_id: (r.text, r.n_chars) for r in C.line_stage(spark, spark.createDataFrame(noted, COLUMNS), DATA).collect()}
    want = {i: (x, len(x) if cut else n) for (i, x, _, cut), (*_, n) in zip(plain_lines([(i, t, s) for i, t, _, s, _ in noted]), noted, strict=True) if not cut or re.search(r"[^\x20\x09-\x0D]", x)}
    assert got == want and sum(common not in t for t, _ in got.values()) >= 100
    # The mixture, by SQL on the same rows.
    table.coalesce(1).write.parquet(f"{tmp_path}/documents")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    mixed = Counter((r.doc_id, r.epoch) for r in C.mixing_stage(spark, table, DATA).collect())
    assert mixed == Counter(map(tuple, db.sql(f"SELECT doc_id, epoch FROM ({ORACLE})").fetchall())) and len(mixed) > 10


def test_stages_on_edges(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows and ids, an empty table, columns whose names clash."""
    import corpus_pipeline as C

    words = "a plain sentence of some words that a person might write on any day of the week. "
    rows = [
        (1, words * 3, "en", "s1", 10), (1, words * 3, "en", "s1", 10), (1, "another text with that id. " + words, None, None, None), (None, words * 2 + "no id", "en", "s2", 1), (None, None, None, None, None),
        (2, None, "en", "s1", 0), (3, "", "en", "s1", 0), (4, " \n\t ", "de", "s1", 3), (5, words * 3000, "en", "s3", 1), (6, words * 3, "fr", "s4", 5),
    ]
    spark.createDataFrame([(1, "an item that no text holds, of enough words to be looked for at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.createDataFrame(rows, COLUMNS), {}
    for name, stage in C.STAGES:
        clash = docs
        for column in ("kept", "verdict", "quality_score", "n_removed", "n_lines", "n_shingles", "component_id", "cut", "row", "epoch", "n_tokens", "domain", "__id"):
            if column not in clash.columns:
                clash = clash.withColumn(column, F.lit("clash"))
        out = stage(spark, clash, str(tmp_path))
        if name != "mixing":
            assert tuple(out.columns) == C.COLUMNS
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        left[name] = Counter((r.doc_id, r.text) for r in docs.collect())
        empty = stage(spark, spark.createDataFrame([], COLUMNS), str(tmp_path))
        assert empty.count() == 0
    assert all(t and t.strip() for _, t in left["quality"]) and left["line_dedup"] == left["quality"]
    ids = {k: sorted((str(i), len(t)) for i, t in v.elements()) for k, v in left.items()}
    assert (6, words * 3) not in left["near_dedup"], ids
    assert (None, words * 2 + "no id") in left["near_dedup"]
    assert (5, words * 3000) not in left["near_dedup"]  # the same set of five words in a row as document 1, or too many repetitions
    assert left["decontamination"] == left["near_dedup"] and set(left["mixing"]) <= set(left["decontamination"])
