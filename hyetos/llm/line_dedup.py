"""Operator 5: remove lines that spread over many sites.

Each line is known by two 64-bit hashes. A HyperLogLog sketch of the sites of every line is built by a partial
aggregation and merged after the shuffle, so a line that stands in a third of all documents still sends one sketch
per task. Sketches are estimates: lines whose estimate is near the threshold get an exact distinct count of their
sites. A line that reaches the threshold is boilerplate. The document with the smallest id that has it keeps it, so
a text that was copied in full survives once; it is cut from all the others.

How many sites a line needs depends on its length (`SITES`): long passages are hardly ever written twice, so a few
sites are enough; short lines, such as a closing brace or "Yes.", are written everywhere, so those under 20 characters
need a share of all sites too.

Places and hashes of all lines are written once. Boilerplate lines are broadcast up to `broadcast_rows` of them and
shuffled beyond; the places to cut come back to their documents, so a text of many cut lines costs no more than the
number of its lines.

Edge cases: null or empty texts pass unchanged; blank lines are never boilerplate; a null site counts for nothing;
cuts are known by id and text, so rows with one id, or none, lose their own boilerplate only; of rows with the smallest
id each keeps the line; a row with a null id keeps a line that only such rows have; of columns that clash with `n_lines`
or `n_removed` the operator's values stay; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyetos.llm.common import kept, once, unused, written

#: (characters from which on, sites that such a line needs, share of all sites that it needs), the longest first.
SITES = ((150, 5, 0.0), (20, 10, 0.0), (1, 16, 0.8))
#: log2 of the sketch's registers, and its relative standard error.
LG_K, ERROR = 12, 1.04 / math.sqrt(2**12)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    line = F.trim(line)
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit(1)).alias("h2"))


def _needed(line: Column, sites, all_sites: int) -> Column:
    """The sites that a line needs to be boilerplate; null for a line that never is."""
    n = F.length(F.trim(line))
    out = F.lit(None).cast("int")
    for chars, needed, share in sorted(sites):
        out = F.when(n >= chars, max(needed, math.ceil(round(share * all_sites, 6)))).otherwise(out)
    return out


def _row(text: Column) -> Column:
    """Two hashes of a text, to tell apart rows that share an id or have none."""
    return F.struct(F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2"))


def boilerplate(docs: DataFrame, sites, broadcast_rows: int, id_col: str, text_col: str, site_col: str) -> tuple[DataFrame, DataFrame]:
    """(lines of documents, boilerplate lines): keys with id, text, site and place, and keys with the first id."""
    all_sites = docs.select(F.col(site_col).cast("string").alias("site")).filter("site is not null").distinct().count() if any(share for *_, share in sites) else 0
    every = F.transform(_lines(F.col(text_col)), lambda x, k: F.struct(_key(x).alias("key"), _needed(x, sites, all_sites).alias("needed"), k.alias("place")))
    keyed = kept(
        docs.select(F.col(id_col).alias("id"), _row(F.col(text_col)).alias("row"), F.col(site_col).cast("string").alias("site"), F.explode(F.filter(every, lambda x: x["needed"].isNotNull())).alias("line"))
        .select("id", "row", "site", "line.key.h1", "line.key.h2", "line.needed", "line.place"),
        "lines",
    )
    margin = F.greatest(F.lit(2.0), F.col("needed") * (4 * ERROR))
    spread = kept(
        keyed.groupBy("h1", "h2", "needed")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("estimate"), F.min("id").alias("first_id"))
        .filter(F.col("estimate") >= F.col("needed") - margin),
        "spread",
    )
    near = spread.filter(F.col("estimate") < F.col("needed") + margin)
    exact = (
        keyed.join(_few(near.select("h1", "h2"), broadcast_rows), ["h1", "h2"], "left_semi")
        .select("h1", "h2", "needed", "site").distinct()
        .groupBy("h1", "h2").agg(F.count("site").alias("sites"), F.first("needed").alias("least"))
        .filter(F.col("sites") >= F.col("least"))
    )
    far = spread.filter(F.col("estimate") >= F.col("needed") + margin)
    lines = far.select("h1", "h2", "first_id").unionByName(near.join(exact, ["h1", "h2"], "left_semi").select("h1", "h2", "first_id"))
    return keyed, written(lines, "boilerplate")


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def line_dedup(
    docs: DataFrame, *, min_sites: int | None = None, sites=SITES, broadcast_rows: int = 500_000,
    id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
) -> DataFrame:
    """The table with boilerplate lines cut from its texts, and the columns n_lines and n_removed.

    `min_sites`: one number of sites for all lines of 20 characters and more, in place of `sites`.
    """
    keyed, lines = boilerplate(docs, sites if min_sites is None else ((20, min_sites, 0.0),), broadcast_rows, id_col, text_col, site_col)
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    row, cut = unused(docs, "row"), unused(docs, "cut")
    cuts = (
        keyed.join(_few(lines, broadcast_rows), ["h1", "h2"])
        .filter(~F.col("id").eqNullSafe(F.col("first_id")))
        .groupBy(F.col("id"), "row").agg(F.collect_set("place").alias(cut))
        .withColumnsRenamed({"id": unused(docs, "id"), "row": f"_{row}"})
    )
    docs = docs.select(*[F.col(f"`{c}`") for c in names], _row(F.col(text_col)).alias(row))
    joined = docs.join(cuts, docs[id_col].eqNullSafe(cuts[cuts.columns[0]]) & (docs[row] == cuts[cuts.columns[1]]), "left")
    n_lines = F.coalesce(F.size(_lines(F.col(text_col))), F.lit(0))
    left = once(_lines(F.col(text_col)), lambda x: F.transform(F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(cut))), lambda k: F.get(x, k)))
    uncut = F.col(cut).isNull() | F.col(text_col).isNull()
    return joined.select(
        *[F.when(uncut, F.col(text_col)).otherwise(F.array_join(left, "\n")).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in names],
        F.when(F.col(text_col).isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.when(uncut, 0).otherwise(F.size(cut)).cast("long").alias("n_removed"),
    )


ORACLE = """
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT trim(line, ' ') AS k, min(doc_id) AS first_id FROM l WHERE length(trim(line, ' ')) >= 1
  GROUP BY 1 HAVING count(DISTINCT source) >= CASE WHEN length(k) >= 150 THEN 5 WHEN length(k) >= 20 THEN 10 ELSE greatest(16, ceil(0.8 * (SELECT count(DISTINCT source) FROM documents))) END
), f AS (
  SELECT l.doc_id, l.pos, l.line, b.k IS NOT NULL AND l.doc_id <> b.first_id AS bad
  FROM l LEFT JOIN b ON trim(l.line, ' ') = b.k
), g AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bad) AS kept,
         count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_removed
  FROM f GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(g.kept, '') END AS text,
       coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN g USING (doc_id)
"""


def op5_line_dedup(spark, sf_dir):
    from hyetos.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup(docs).select("doc_id", "text", "n_lines", "n_removed")
