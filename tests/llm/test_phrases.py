"""Phrases against a plain count, with chunks of any size."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hyetos.llm.phrases import phrases


def plain(rows, *, least, longest=4, subsumed=80, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = Counter()
    for (lang, *words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                key = (lang, *words[i : i + k])
                inside[key] = max(inside[key], a)
    for (lang, *words), a in candidates.items():
        score, k = min((2_000_000 * a // (f[(lang, *words[:k])] + f[(lang, *words[k:])]), k) for k in range(1, len(words)))
        if 100 * inside[(lang, *words)] < subsumed * a:
            out.append((lang, score, a, " ".join(words), f[(lang, *words[:k])], f[(lang, *words[k:])]))
    ranked, at = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out, key=lambda x: (x[0], -x[1], -x[2], x[3].encode())):
        at[lang] += 1
        if at[lang] <= top:
            ranked.append((lang, at[lang], phrase, a, left, right, n[lang], score))
    return ranked


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("chunk", [3, 50, 1 << 21])
def test_against_a_plain_count(spark, chunk):
    rng = random.Random(5)
    words = ["The", "the", "é", "a\x00b", "x", "y", "zz", "Ä", " ", "q'"]
    gaps = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\x0b", "\r\n", "!?", " ; ", ":"]
    rows = [("".join(x for _ in range(rng.choice([0, 1, 3, 40, 200])) for x in (rng.choice(words), rng.choice(gaps))), rng.choice(["en", "en", "fr", None, "und"])) for _ in range(60)]
    rows += [(None, "en"), ("", None), (" .. ", "de"), ("x y zz " * 400, "es"), ("x y zz " * 400, "es"), ("w" * 5000 + " " + "w" * 5000, "en")] + [("Same text, twice over", "it")] * 40
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    for name in ("doc_id", "chunk", "tokens", "word", "n", "l", "r", "name", "f", "a", "rank", "of"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = rows_of(phrases(docs, least=10, chunk=chunk))
    assert got == sorted(plain(rows, least=10)) and len(got) > 40


def test_ties_top_and_other_lengths(spark):
    rows = [("b a. a b. c d. d c", "en")] * 12
    docs = spark.createDataFrame(rows, "text string, lang string")
    for top in (3, 10):
        got = phrases(docs, least=12, longest=3, top=top)
        assert rows_of(got) == sorted(plain(rows, least=12, longest=3, top=top))
        assert [r.phrase for r in got.orderBy("rank").collect()] == ["a b", "b a", "c d", "d c"][:top]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases(empty).collect() == [] and phrases(spark.createDataFrame([(None, "en")], "text string, lang string")).collect() == []
