"""Block-Max WAND against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hyetos.llm.wand import Shard, _postings, build_index, decode, encode, search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    bags = [(i, Counter(terms(x))) for i, x in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    count, total, df = len(bags), sum(n for *_, n in bags), Counter(t for _, b, _ in bags for t in b)
    asked = {}
    for i, x in items:
        asked.setdefault(i, set()).update(terms(x))
    out = []
    for item, words in asked.items():
        weights = {t: math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) for t in words if t in df}
        scored = [(sum(w * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * (10 + 90 * n * count // total))) for t, w in weights.items() if b[t]), i) for i, b, n in bags]
        scored = sorted((-s, i is None, i) for s, i in scored if s > 0)[:k]
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(scored, 1)]
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = ["the"] * 30 + ["of"] * 20 + [f"w{min(int(rng.paretovariate(0.6)), 500)}" for _ in range(400)] + ["Ünï", "x²", "naïve", "日本", "0", "007"]
    make = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", ", ", "\n", "-", "_"]) for _ in range(n))
    docs = [(k, make(rng.choice([0, 1, 5, 30, 120]))) for k in range(600)]
    docs += [(1000 + k, docs[4][1]) for k in range(200)]  # ties across shards
    docs += [(None, "only here nowhere else"), (None, docs[4][1]), (7, docs[4][1]), (5000, None), (5001, " .,-_ "), (5002, "The The the " * 5000), (5003, "é" * 100_000 + " w1")]
    items = [(k, docs[rng.randrange(600)][1] + " w1 the") for k in range(25)] + [(100, None), (101, ""), (102, "absent words"), (103, "only"), (None, "w2 w3"), (3, "naïve Ünï"), (104, docs[4][1]), (105, "the")]
    return docs, items


@pytest.mark.parametrize(("words", "block", "batch"), [(1 << 22, 128, 100_000), (700, 4, 40)])
def test_against_all_documents(spark, corpus, words, block, batch):
    docs, items = corpus
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for name in ("term", "item", "id", "shard", "batch", "n", "score", "rank", "w", "q"):
        df, asked = df.withColumn(name, F.lit("clash")), asked.withColumn(name, F.lit("clash"))
    index, count = build_index(df, shard_words=words, block=block)
    assert index.filter("term is null").agg(F.sum("n")).first()[0] == count
    same(search(index, count, asked, batch_terms=batch), plain(docs, items))


def test_blocks_stay_compressed():
    """Documents that can't reach the best ten aren't decompressed, and the ten are right."""
    rng = random.Random(9)
    docs = [(k, "rare gem " * 5 if k in range(5000, 5012) else " ".join(rng.choices(["the", "of", "and", "gem"] + [f"v{j}" for j in range(300)], k=40))) for k in range(8000)]
    count, total = len(docs), sum(len(x.split()) for _, x in docs)
    from unittest.mock import patch

    with patch("hyetos.llm.wand.TaskContext") as context:
        context.get.return_value.partitionId.return_value = 0
        ids, texts = zip(*docs, strict=True)
        blocks = list(_postings(count, total, 1 << 30, 16)(iter([pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], ["id", "text"])])))
    shard = Shard(pa.Table.from_batches(blocks))
    df = Counter(t for _, x in docs for t in set(x.split()))
    words = ["the", "rare", "gem", "of"]
    found, scores = shard.search(words, [math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) for t in words], 10)
    assert [(1, r, d, s) for r, (d, s) in enumerate(zip(found.tolist(), scores.tolist(), strict=True), 1)] == plain(docs, [(1, " ".join(words))])
    touched = shard.from_[[shard.codes[t] for t in words]], shard.from_[[shard.codes[t] + 1 for t in words]]
    assert 0 < shard.opened.sum() < 0.2 * sum(b - a for a, b in zip(*touched, strict=True))


def test_codec():
    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 40, 5, (1 << 62) + 3])
    data, starts = encode(values)
    assert decode(data).tolist() == values.tolist() and starts[:4].tolist() == [0, 1, 2, 3]
    assert decode(encode(np.empty(0, np.int64))[0]).tolist() == []


def test_nothing(spark):
    none, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search(*build_index(none), items).collect() == []
    index, n = build_index(spark.createDataFrame([(1, "b"), (2, None)], "doc_id long, text string"))
    assert n == 1 and search(index, n, items).collect() == [] and search(index, n, items.limit(0)).collect() == []
