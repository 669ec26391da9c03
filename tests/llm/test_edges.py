"""Every operator on nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_tokens string, score string, pii string, n_lines string, component_id string, host string, epoch string"
LONG = "the quick brown fox jumps over the lazy dog near the river bank today. " * 3000
ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (None, "a text without an id that is long enough", "en", None), (4, LONG, "en", "b"), (5, LONG, "en", "c"),
    (6, "one", "de", "c"), (6, "one", "de", "c"), (7, "Ünïcödé wörds 1234 !!", "de", "b"), (8, "mail a@b.org or +1 (743) 555-3824 please", "en", "b"), (-9, "der die das und ist nicht ein", "de", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, None, *["x"] * 8) for r in ROWS], SCHEMA)


def operators():
    from hyetos.llm import decontaminate, langid, line_dedup, lm_score, minhash, mixing, pii, quality, url_filter

    return {
        "langid": lambda d: langid.identify(d, langid.learn(d), carry=["doc_id", "score"]),
        "urls": lambda d: url_filter.url_verdicts(d, url_col="text"),
        "decontaminate": lambda d: decontaminate.decontaminate(d, d.select(F.col("doc_id").alias("item_id"), "text").filter("doc_id = 4")),
        "lm": lambda d: lm_score.lm_scores(d, burn=1, samples=1),
        "lines": lambda d: line_dedup.line_dedup(d, min_sites=2),
        "pii": pii.find_pii,
        "minhash": minhash.near_duplicates,
        "mixing": lambda d: mixing.mix(d, path=("lang", "source"), budget_share=0.5),
        "quality": quality.quality,
    }


@pytest.mark.parametrize("name", list(operators()))
def test_runs_on_edges_and_on_nothing(docs, name):
    run = operators()[name]
    out = run(docs)
    if name not in ("decontaminate", "mixing"):
        assert out.count() == len(ROWS)
    assert run(docs.limit(0)).count() == 0


def test_minhash(docs):
    got = operators()["minhash"](docs).collect()
    by = {r.doc_id: r for r in got}
    assert by[5].component_id == 4 and not by[5].kept and by[4].kept and by[6].component_id == 6
    assert by[1].n_shingles == 0 and by[1].component_id == 1 and by[2].kept and by[3].kept and by[None].kept


def test_langid(docs):
    by = {r.doc_id: r for r in operators()["langid"](docs.drop("score").withColumn("score", F.lit("x"))).select("doc_id", "lang_pred").collect()}
    assert by[1].lang_pred == "und" and by[3].lang_pred == "und" and by[-9].lang_pred == "de" and by[5].lang_pred == "en"


def test_exact(spark, docs, tmp_path):
    from hyetos.llm.exact_dedup import exact_dedup

    docs.write.parquet(str(tmp_path / "d"))
    got = exact_dedup(spark, str(tmp_path / "d")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ROWS) and by[5].keep_id == 4 and not by[5].kept and by[6].group_size == 2
    assert by[1].keep_id == 3 and by[2].keep_id == 3 and by[3].kept and by[3].group_size == 3
    docs.limit(0).write.parquet(str(tmp_path / "e"))
    assert exact_dedup(spark, str(tmp_path / "e")).count() == 0


def test_exact_in_many_batches(spark, tmp_path):
    from hyetos.llm.exact_dedup import exact_dedup

    rows = [(k, "same text" + " " * (k % 5) if k % 3 else f"text {k}") for k in range(60)]
    for part in range(6):
        spark.createDataFrame(rows[part::6], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    got = {r.doc_id: r for r in exact_dedup(spark, str(tmp_path / "d"), files_per_trigger=1).collect()}
    assert {got[k].keep_id for k in range(60) if k % 3} == {4} and got[4].group_size == 40 and got[4].kept


def test_lines(spark):
    from hyetos.llm.line_dedup import line_dedup

    line = "All rights are reserved by the owner."
    rows = [(k, f"{line}\nown line number {k} of this text\nshort", f"s{k % 4}") for k in range(8)] + [(9, line, None), (10, "two\nlines", "s9")]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=4).collect()}
    assert got[0].n_removed == 0 and got[3].text == "own line number 3 of this text\nshort" and got[3].n_removed == 1 and got[9].text == "" and got[10].n_removed == 0
    assert all(r.n_removed == 0 for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=5).collect())


def test_decontamination(spark):
    from hyetos.llm.decontaminate import contaminated

    items = spark.createDataFrame([(1, "Alice said that Tom Brown buys 12 apples for 3 dollars and then sells 12 apples to Mary at noon near the old river bank"), (2, "tiny")], "item_id long, text string")
    same = "we saw Alice said that Bob White buys 15 apples for 7 euros and then sells {} apples to Jane at noon near the old river bank"
    docs = spark.createDataFrame([(1, same.format(15)), (2, same.format(16)), (3, None), (None, same.format(15)), (4, "and then sells apples to Mary")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()] == [(1, 1)]
    assert [(r.doc_id, r.item_id) for r in contaminated(docs, items, broadcast_rows=0).collect()] == [(1, 1)]


def test_mixing_moves_shortages_to_siblings_first(spark):
    from hyetos.llm.mixing import budgets, mix

    leaves = spark.createDataFrame([("x", "a", 10), ("x", "b", 1000), ("y", "c", 1000)], "p string, q string, supply long")
    got = {r.q: r.budget for r in budgets(leaves, ["p", "q"], {}, F.lit(800.0), 1).collect()}
    assert got == {"a": 10, "b": 390, "c": 400}
    got = {r.q: r.budget for r in budgets(leaves.filter("q <> 'b'"), ["p", "q"], {}, F.lit(800.0), 1).collect()}
    assert got == {"a": 10, "c": 790}
    docs = spark.createDataFrame([(k, "w " * 10, "x" if k < 50 else "y") for k in range(100)], "doc_id long, text string, source string")
    out = mix(docs, path=["source"], weights={"source": {"x": 3.0, "y": 1.0}}, budget_tokens=1200, max_epochs=2)
    assert {r.source: r.n for r in out.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()} == {"x": 900, "y": 300}
    assert out.groupBy("doc_id", "epoch").count().filter("count > 1").count() == 0
