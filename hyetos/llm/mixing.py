"""Operator 9: mixing sources to target weights under a token budget.

The tree is domain, language, source. Capacities (tokens times `max_epochs`) are summed upward; the budget runs
downward: at each node it is dealt to the children by weight, and what a child can't fill goes to its siblings, again
by weight (found exactly from running sums by capacity over weight). A node whose whole subtree falls short already has
a smaller capacity at its parent, so only then does the shortage reach the parent's siblings.

A leaf whose share is e times its supply and r tokens takes e whole epochs and of the next one the documents before
the r-th token. Each epoch has its own order, the md5 of seed, epoch and id. The prefix is found in two steps: token
sums in 65,536 ranges of the order, then a running sum inside the one range where the prefix ends. So no leaf is
sorted in one task, even if it holds a third of all rows. The plan has a row for each leaf and is broadcast up to
`broadcast_rows` rows, else joined by a shuffle that Spark splits at hot leaves.

Edge cases: null path values are a node of their own, `(none)`; a null or empty text has no tokens; rows without
tokens come along where they lie before the end of a prefix; leaves without tokens get nothing; a budget above all
capacities takes everything `max_epochs` times; rows with the same id keep the same place in each epoch; extra
columns pass through, and of columns that clash with the results the operator's values stay; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hyetos.llm.common import table, written

DOMAINS = {"web": 0.4, "books": 0.6}
LANGUAGES = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}
PATH = ("domain", "lang", "source")
NONE = "(none)"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source of the test tables: src0 to src9 stand for the web, the others for books."""
    return F.when(F.length(source) <= 4, "web").otherwise("books")


def _weight(column: Column, weights: Mapping[str, float]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(column == name, F.lit(float(w))).otherwise(out)
    return out


def budgets(leaves: DataFrame, path: Sequence[str], weights: Mapping[str, Mapping[str, float]], budget: Column, max_epochs: int) -> DataFrame:
    """From leaves (path, supply): the same with `budget`, in tokens."""
    nodes = leaves.select(*path, "supply", (F.col("supply") * max_epochs).cast("double").alias("cap"))
    shares = nodes.agg(budget.cast("double").alias("budget"))
    for k in range(len(path)):
        at, above = list(path[: k + 1]), list(path[:k])
        level = nodes.groupBy(*at).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(F.col(path[k]), weights.get(path[k], {})))
        level = level.filter("weight > 0")
        level = level.join(shares, above) if above else level.join(shares, F.lit(True))
        level = level.withColumn("full_at", F.col("cap") / F.col("weight"))
        order = W.partitionBy(*above or [F.lit(0)]).orderBy("full_at", path[k])
        filled = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        weight = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
        level = level.withColumn("rate", (F.col("budget") - filled) / weight)
        rate = F.max(F.when(F.col("rate") < F.col("full_at"), F.col("rate"))).over(W.partitionBy(*above or [F.lit(0)]))
        shares = level.select(*at, F.coalesce(F.least("cap", rate * F.col("weight")), "cap").alias("budget"))
    return leaves.join(shares, list(path)).withColumn("budget", F.floor(F.col("budget") + 1e-6).cast("long"))


def mix(
    docs: DataFrame, *, path: Sequence[str] = PATH, weights: Mapping[str, Mapping[str, float]] | None = None, budget_share: float = 0.5,
    budget_tokens: int | None = None, max_epochs: int = 2, seed: int = 17, tokens: Column | None = None, id_col: str = "doc_id",
    text_col: str = "text", broadcast_rows: int = 100_000,
) -> DataFrame:
    """The selected documents, a row for each epoch that takes one, with n_tokens and epoch."""
    weights = {"domain": DOMAINS, "lang": LANGUAGES} if weights is None else weights
    keep = [c for c in docs.columns if c not in ("n_tokens", "epoch")]
    leaf = [f"__leaf_{k}" for k in range(len(path))]
    named = dict(zip(leaf, path, strict=True))
    docs = docs.withColumns({"__tokens": n_words(F.col(text_col)) if tokens is None else tokens} | {k: F.coalesce(F.col(c).cast("string"), F.lit(NONE)) for k, c in named.items()})
    order = lambda epoch: F.md5(F.concat_ws("-", F.lit(seed), epoch, F.coalesce(F.col(id_col).cast("string"), F.lit(""))))

    sizes = written(docs.select(F.col(id_col), "__tokens", *leaf), "sizes")
    supply = sizes.groupBy(*leaf).agg(F.sum("__tokens").alias("supply"))
    budget = F.lit(float(budget_tokens)) if budget_tokens is not None else F.floor(F.sum("supply") * F.lit(budget_share))
    plan = written(
        budgets(supply, leaf, {k: weights.get(c, {}) for k, c in named.items()}, budget, max_epochs)
        .filter("supply > 0")
        .select(*leaf, F.expr("cast(budget div supply as int)").alias("__whole"), F.expr("budget % supply").alias("__rest")),
        "plan",
    )
    spread = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    place = F.left("__order", F.lit(4))
    part = sizes.join(spread(plan), leaf).filter("__rest > 0").select(*leaf, "__rest", "__tokens", order(F.col("__whole")).alias("__order"))
    ranges = part.groupBy(*leaf, "__rest", place.alias("__range")).agg(F.sum("__tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*leaf).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = (
        ranges.withColumn("__before", before).filter(F.col("__before") < F.col("__rest"))
        .groupBy(*leaf).agg(F.max_by(F.struct("__range", "__before"), "__range").alias("m")).select(*leaf, "m.*")
    )
    ends = written(plan.join(last, leaf, "left"), "ends")

    at = docs.join(spread(ends), leaf).withColumn("__order", order(F.col("__whole")))
    inside = F.coalesce(place < F.col("__range"), F.lit(False))
    epochs = F.concat(
        F.when(F.col("__whole") > 0, F.sequence(F.lit(0), F.col("__whole") - 1)).otherwise(F.expr("array()").cast("array<int>")),
        F.when(inside, F.array("__whole")).otherwise(F.expr("array()").cast("array<int>")),
    )
    out = [*[F.col(f"`{c}`") for c in keep], F.col("__tokens").alias("n_tokens")]
    most = at.select(*out, F.explode(epochs).alias("epoch"))
    edge = at.filter(place == F.col("__range"))
    sums = F.coalesce(F.sum("__tokens").over(W.partitionBy(*leaf).orderBy("__order", "__tokens").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = edge.withColumn("__sum", sums + F.col("__before")).filter(F.col("__sum") < F.col("__rest")).select(*out, F.col("__whole").alias("epoch"))
    return most.unionByName(edge)


def op9_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").withColumn("domain", domain_of(F.col("source")))
    return mix(docs).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def _oracle() -> str:
    weights = lambda c, w: "CASE " + " ".join(f"WHEN {c} = '{k}' THEN {v}" for k, v in w.items()) + " ELSE 1.0 END"
    sql = """
WITH d AS (
  SELECT doc_id, CASE WHEN length(source) <= 4 THEN 'web' ELSE 'books' END AS domain, lang, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
  FROM documents
), leaf AS (
  SELECT domain, coalesce(lang, '(none)') AS l, coalesce(source, '(none)') AS s, sum(n_tokens)::BIGINT AS supply FROM d GROUP BY ALL
), n0 AS (SELECT floor(sum(supply) * 0.5)::DOUBLE AS budget FROM leaf)
"""
    above = []
    for k, (c, w) in enumerate((("domain", weights("domain", DOMAINS)), ("l", weights("l", LANGUAGES)), ("s", "1.0"))):
        keys = ", ".join([*above, c])
        part = f"PARTITION BY {', '.join(above)}" if above else ""
        sql += f""", a{k} AS (
  SELECT {keys}, {w}::DOUBLE AS weight, sum(supply * 2)::DOUBLE AS cap FROM leaf GROUP BY {keys}
), b{k} AS (
  SELECT a{k}.*, budget, cap / weight AS full_at,
         (budget - coalesce(sum(cap) OVER ({part} ORDER BY cap / weight, {c} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER ({part} ORDER BY cap / weight, {c} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM a{k} {f'JOIN n{k} USING ({", ".join(above)})' if above else f'CROSS JOIN n{k}'}
), n{k + 1} AS (
  SELECT {keys}, coalesce(least(cap, weight * max(CASE WHEN rate < full_at THEN rate END) OVER ({part})), cap) AS budget FROM b{k}
)"""
        above.append(c)
    return sql + """, plan AS (
  SELECT domain, l, s, floor(budget + 1e-6)::BIGINT // supply AS whole, floor(budget + 1e-6)::BIGINT % supply AS rest
  FROM leaf JOIN n3 USING (domain, l, s) WHERE supply > 0
), o AS (
  SELECT d.*, whole, rest,
         coalesce(sum(n_tokens) OVER (PARTITION BY d.domain, l, s ORDER BY md5('17-' || whole || '-' || doc_id), n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN plan p ON d.domain = p.domain AND coalesce(d.lang, '(none)') = l AND coalesce(d.source, '(none)') = s
)
SELECT doc_id, domain, lang, source, n_tokens, e.epoch::INTEGER AS epoch FROM o, range(whole) e(epoch)
UNION ALL
SELECT doc_id, domain, lang, source, n_tokens, whole::INTEGER FROM o WHERE before < rest
"""


ORACLE = _oracle()
