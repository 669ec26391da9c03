"""Operator 3: documents that contain benchmark items, also with other numbers, names or units.

Texts become templates: numbers, English number words, capitalised names within sentences, and units after digits turn
to typed placeholders that carry their value; other words are lower-cased and stripped of punctuation. A number in
several words ("twenty-five") is several numbers. Windows of eight template
words are hashed (by doubling: pairs, fours, eights) and joined with those of the benchmark. Of a document and an item,
matches with the same offset form one occurrence. Its slots are consistent when each benchmark value that the item
repeats was replaced by one value: of the repetitions at least half must agree, or the occurrence is dropped. Two
different values may become the same one. A document is contaminated by an item when consistent occurrences match
`min_windows` of its windows (six: 13 words in a row), or all where it has fewer.

An item of four to seven words is found by all its windows of four words in a row. The first word of an item counts
both as a word and, if it is capitalised, as a name, as it may follow a word in the document. A window of which more
than half are placeholders is used only for items that would have fewer than `min_windows` windows without such, and if
at least two words are left.

Documents are read once and only window hashes leave the row; values of slots are looked up again only in documents
that matched a window with slots. The benchmark's windows are broadcast up to `broadcast_rows` rows; beyond, hashes
are shuffled and Spark splits hot ones.

Edge cases: a null or empty text matches nothing; an item of fewer than four words, or without a window that may be
used, can't be found; a document with a null id is not searched; rows with the same id are one document; repeated
items are reported each, and a window that an item repeats counts once; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyetos.llm.common import once, table, written

WINDOW, SHORT = 8, 4
# Units that may follow a number, and English number words.
UNITS = (
    "percent|dollars|dollar|euros|euro|pounds|pound|cents|cent|km|kilometers|kilometres|meters|metres|meter|metre|m|miles|mile|cm|mm|feet|inches|"
    "kg|kilograms|grams|gram|g|mg|tons|ounces|oz|lbs|lb|liters|litres|liter|litre|l|ml|gallons|hours|hour|hrs|hr|h|minutes|minute|mins|min|seconds|second|secs|sec|s|"
    "days|day|weeks|week|months|month|years|year|degrees|degree|mph|kmh|kph|watts|volts"
)
NUMBER_WORDS = tuple(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
)
NUMBER = r"[0-9](?<![\p{L}0-9][0-9])[0-9]*+(?:[.,][0-9]++)*+"
NAME = r"\p{Lu}(?<=[\p{L}\p{N},;:]\s\p{Lu})\p{Ll}++(?!\p{L})"
BETWEEN = r"(?:[^\p{L}\p{N}<.,]|[.,](?![0-9])|(?<![0-9])[.,])+"


def template(text: Column) -> Column:
    """Words of the template; a placeholder is `<n`, `<a` or `<u` with its value."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("<"), F.lit(" "))
    t = F.regexp_replace(t, NAME, " <a$0 ")
    # A number is marked once, as a whole; only then the unit after it.
    numbered = F.regexp_replace(t, rf"({NUMBER})(?=(?:{UNITS})\b|(?!\p{{L}}))", " <n$1 ")
    numbered = F.regexp_replace(numbered, rf"(<n[^\s<]++) \s?({UNITS})\b", "$1 <u$2 ")
    t = F.when(F.rlike(t, F.lit("[0-9]")), numbered).otherwise(t)
    return F.transform(F.split(F.lower(t), BETWEEN), lambda w: F.when(w.isin(*NUMBER_WORDS), F.concat(F.lit("<n"), w)).otherwise(w))


def _pairs(h: Column, by: int) -> Column:
    n = F.size(h) - by
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(1 + by), n), lambda a, b: F.xxhash64(a, b))


def _hashes(words: Column, size: int) -> Column:
    """The hash of every window of `size` words; each step is bound once, so that no step is computed again for the next."""

    def doubled(h: Column, by: int) -> Column:
        return h if by == size else once(_pairs(h, by), lambda x: doubled(x, 2 * by))

    single = F.transform(words, lambda w: F.xxhash64(F.when(F.startswith(w, F.lit("<")), F.left(w, F.lit(2))).otherwise(w)))
    return once(single, lambda h: doubled(h, 1))


def windows(rows: DataFrame, words: Column, *keep: str, size: int = WINDOW) -> DataFrame:
    """One row for each window of `words` with its hash and place; a null hash where there is none."""
    hashes = once(words, lambda w: F.when(F.size(w) >= size, _hashes(w, size)))
    # The outer form, as the inner one makes Spark compute the hashes a second time to drop empty rows.
    return rows.select(*keep, F.posexplode_outer(hashes).alias("place", "hash"))


def _slots(words: Column, place: Column, size: int = WINDOW) -> Column:
    """(place in the text, value) of every placeholder of a window."""
    at = F.transform(F.slice(words, place + 1, F.lit(size)), lambda w, k: F.struct((place + k).alias("at"), w.alias("value")))
    return F.filter(at, lambda x: F.startswith(x["value"], F.lit("<")))


def _asked(items: DataFrame, size: int, min_windows: int) -> DataFrame:
    """The windows by which the items with these template words are found: item, place, hash, slots."""
    first = F.col("words")[0]
    named = F.concat(F.array(F.concat(F.lit("<a"), first)), F.slice("words", F.lit(2), F.size("words")))
    rows = items.withColumn("start", F.lit(-1)).unionByName(items.filter(F.col("capital") & ~F.startswith(first, F.lit("<"))).withColumn("words", named).withColumn("start", F.lit(0)))
    every = once(F.col("words"), lambda w: F.transform(_hashes(w, size), lambda h, k: F.struct(k.alias("place"), h.alias("hash"), _slots(w, k, size).alias("slots"))))
    found = rows.select("item", "start", F.explode(every).alias("w")).select("item", "start", "w.*").filter("start < 0 or place = 0").drop("start")
    # A window that an item repeats stands for all its places, or a text of one phrase again and again would match each with each.
    found = written(found.groupBy("item", "hash").agg(F.min_by(F.struct("place", "slots"), "place").alias("w")).select("item", "hash", "w.*"), "all-windows")
    plain = written(found.filter(F.size("slots") <= size // 2), "plain-windows")
    enough = plain.groupBy("item").agg(F.countDistinct("place").alias("n")).filter(F.col("n") >= min_windows).select("item")
    rich = found.filter((F.size("slots") > size // 2) & (F.size("slots") <= size - 2)).join(enough, "item", "left_anti")
    return plain.unionByName(rich)


def contaminated(
    docs: DataFrame, items: DataFrame, *, min_windows: int = 6, broadcast_rows: int = 500_000,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(id, item, n_windows, item_windows) of every document and item of which enough windows match."""
    spread = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).filter("doc is not null and text is not null")
    capital = F.rlike(F.coalesce(F.col(item_text_col), F.lit("")), F.lit(r"^[^\p{L}\p{N}]*\p{Lu}\p{Ll}++(?!\p{L})"))
    lines = items.select(F.col(item_col).alias("item"), capital.alias("capital"), F.filter(template(F.col(item_text_col)), lambda w: w != "").alias("words"))
    # Two rows with the same item and text are told apart by nothing, and not needed twice.
    lines = written(lines.distinct(), "items")
    few = F.size("words") < WINDOW
    sized = {WINDOW: lines.filter(~few), SHORT: lines.filter(few & (F.size("words") >= SHORT))}
    sized = {size: written(_asked(part, size, min_windows if size == WINDOW else 1), "item-windows") for size, part in sized.items() if not part.isEmpty()}
    asked = lines.sparkSession.createDataFrame([], lines.select("item").schema).selectExpr("item", "0 as place", "0 as size")
    found = None
    for size, part in sized.items():
        near = spread(part.select("item", F.col("place").alias("item_place"), "hash", "slots"))
        hits = windows(texts, template(F.col("text")), "doc", size=size).join(near, "hash").select("doc", "place", "item", "item_place", "slots", F.lit(size).alias("size"))
        found = hits if found is None else found.unionByName(hits)
        asked = asked.unionByName(part.select("item", "place", F.lit(size).alias("size")))
    if found is None:
        return texts.join(lines, F.lit(False)).select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.lit(0).cast("long").alias("n_windows"), F.lit(0).cast("long").alias("item_windows"))
    found = written(found, "found")
    key = ["doc", "item", "offset"]
    hits = found.withColumn("offset", F.col("place") - F.col("item_place"))
    slotted = hits.filter(F.size("slots") > 0)
    if not slotted.isEmpty():
        ids = slotted.select("doc").distinct()
        values = texts.join(spread(written(ids, "slotted")), "doc", "left_semi").select("doc", template(F.col("text")).alias("words"))
        pairs = (
            slotted.join(values, "doc")
            .select(*key, F.explode(F.transform("slots", lambda x: F.struct(x["at"].alias("at"), x["value"].alias("theirs"), F.get("words", x["at"] + F.col("offset")).alias("ours")))).alias("s"))
            .select(*key, "s.*").distinct()
        )
        same = pairs.groupBy(*key, "theirs", "ours").agg(F.countDistinct("at").alias("n")).groupBy(*key, "theirs").agg((F.sum("n") - 1).alias("again"), (F.max("n") - 1).alias("agree"))
        wrong = same.groupBy(*key).agg(F.sum("again").alias("again"), F.sum("agree").alias("agree")).filter("again > 0 and 2 * agree < again").select(*key)
        hits = hits.join(wrong, key, "left_anti")
    total = asked.groupBy("item").agg(F.countDistinct("place").alias("item_windows"))
    # A short item is found where all its windows match at one offset.
    matched = hits.select("doc", "item", "size", F.when(F.col("size") == SHORT, F.col("offset")).alias("offset"), "item_place").distinct()
    matched = matched.groupBy("doc", "item", "offset").agg(F.count("*").alias("n_windows")).groupBy("doc", "item").agg(F.max("n_windows").alias("n_windows"))
    least = F.least(F.lit(min_windows), F.col("item_windows"))
    return (
        matched.join(total, "item").filter(F.col("n_windows") >= least)
        .select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_windows", "item_windows")
    )


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", broadcast_rows: int = 500_000, **options) -> DataFrame:
    """The documents without those that an item contaminates; documents with a null id stay."""
    ids = written(contaminated(docs, items, id_col=id_col, **options).select(F.col(id_col).alias("__leak")).distinct(), "leaks")
    if ids.count() <= broadcast_rows:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[id_col] == ids["__leak"], "left_anti")


def op3_decontaminate(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
