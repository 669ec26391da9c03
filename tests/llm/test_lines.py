"""Line deduplication: nothing but boilerplate is ever cut."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from hyetos.llm.line_dedup import line_dedup


def plain(rows, many=16):
    """(text, lines, removed) of each row, from exact sets of sites."""
    sites, first = defaultdict(set), {}
    every = len({s for _, _, s in rows if s is not None})
    for i, text, site in rows:
        for line in ([] if text is None else text.split("\n")):
            key = line.strip(" ")
            if site is not None:
                sites[key].add(site)
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, text, _ in rows:
        lines = [] if text is None else text.split("\n")
        keep = []
        for line in lines:
            key = line.strip(" ")
            need = 5 if len(key) >= 150 else 10 if len(key) >= 20 else max(many, -(-4 * every // 5))
            if not key or len(sites[key]) < need or i == first.get(key):
                keep.append(line)
        out.append((i, None if text is None else "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = line_dedup(docs, **options).select("doc_id", "text", "n_lines", "n_removed")
    assert Counter(map(tuple, got.collect())) == Counter(plain(rows))


def test_null_and_repeated_ids_lose_nothing_else(spark):
    common = "this line stands on each and every site of all"
    rows = [(k, f"{common}\nown words of document {k}", f"s{k}") for k in range(12)]
    rows += [(None, "NULLB precious first line\nmore", "s1"), (None, f"{common}\nNULLA own", "s2"), (5, f"other row of five\n{common}", "s3"), (5, f"{common}\nthird row of five", "s4"), (0, f"second row\n{common}", "s5")]
    for few in (500_000, 0):
        check(spark, rows, broadcast_rows=few)


def test_random_rows(spark):
    rng = random.Random(8)
    pool = [f"a passage that many pages share, number {k}" for k in range(6)] + ["}", "", "  ", "Yes.", "x" * 160] + [f"unique {k} " + "y" * 30 for k in range(200)]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", "\n".join(rng.choice(pool) + rng.choice(["", " "]) for _ in range(rng.randrange(12)))]) if rng.random() < 0.3 else "\n".join(rng.choice(pool[:20]) for _ in range(5)),
             rng.choice([None, *(f"s{k}" for k in range(25))])) for _ in range(300)]
    check(spark, rows)


def test_code_keeps_its_short_lines(spark):
    rows = [(k, f"def f{k}():\n    if x:\n        return x\n}}\nYes.\nreturn {k}", f"site{k % 60}") for k in range(90)]
    rows += [(100 + k, f"prose of document {k}", f"plain{k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_removed", F.lit("clash"))
    for name in ("id", "row", "_row", "cut", "place", "site"):
        docs = docs.withColumn(name, F.lit(1))
    assert line_dedup(docs).agg(F.sum("n_removed")).first()[0] == 0
    check(spark, rows)
