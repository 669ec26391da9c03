r"""Operator 12: phrases of two and more words, named pair by pair.

Texts become chunks of word numbers, each about CHUNK words and ended at a break between pieces. At each level a chunk
says which pairs of neighbouring (k-1)-grams it has and how often. Pairs are dealt by their two names to as many buckets
as there are chunks, where the counts of all chunks meet; those that are frequent get a global name. Each chunk is told the
names of its own pairs, which replace them; all other pairs become breaks, as no frequent longer phrase holds one. A name keeps the two names it was made of (all but its
last word, all but its first). These parent pointers give the counts of every cut, as prefixes of the left and suffixes
of the right parent, and what a longer phrase subsumes: a phrase inside any longer one is inside one of the next level
that is at least as frequent, so parents of one level decide.

Words and pairs are counted exactly: words by their bytes, pairs by their names. A task holds one chunk or one bucket at
a time. A bucket has about as many pairs as a chunk, and of one pair a number from each chunk, so a hot pair adds a few
bytes a chunk to its bucket. Names of words are broadcast up to BROADCAST_ROWS rows and BROADCAST_BYTES of words, beyond
they meet the words of the chunks in a shuffle.

Edge cases: a null text has no words; a null language counts as `und`; pieces without words vanish; rows that are
repeated count each time; a very long text is read in slices, and a chunk grows beyond CHUNK only while a piece goes on;
equal scores and counts are ordered by phrase; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyetos.llm.chunks import cuts_of, distinct, spread, squeeze
from hyetos.llm.common import discard, kept, table, written

CHUNK, SLICE, BATCH = 1 << 21, 1 << 20, 100_000
BROADCAST_ROWS, BROADCAST_BYTES = 1 << 19, 64 << 20
#: Bits of a chunk's number for its place in the task.
TURN_BITS = 14
#: A-Z lower-cased, tabs as spaces, all that ends a piece as full stops.
_table = bytearray(range(256))
_table[ord("A") : ord("Z") + 1] = b"abcdefghijklmnopqrstuvwxyz"
_table[9] = ord(" ")
for _c in b".,;:!?\n\x0b\x0c\r":
    _table[_c] = ord(".")
PLAIN = bytes(_table)
GAP = re.compile(rb"[ .]")

WORDS = "chunk long, tokens binary, pos long, lang string, word string, n long"
SENT = "chunk long, tokens binary, bucket int, start long, l binary, r binary, n binary"
NAMED = "chunk long, start long, at binary, names binary, l long, r long, f long, name long"


def _slices(data: bytes, size: int) -> Iterator[tuple[bytes, bool]]:
    """Slices of a text in plain bytes, none within a word; whether a piece ends with the slice."""
    at = 0
    while len(data) - at > size:
        end = data.rfind(b".", at, at + size) + 1
        broken = end > at
        if not broken:
            end = data.rfind(b" ", at, at + size) + 1
        if end <= at:
            gap = GAP.search(data, at + size)
            if not gap:
                break
            end = gap.end()
            broken = data[end - 1 : end] == b"."
        yield data[at:end], broken
        at = end
    yield data[at:], True


def _chunks(size: int, part_bytes: int):
    schema = pa.schema([("chunk", pa.int64()), ("tokens", pa.binary()), ("pos", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of word numbers, and the distinct words of each with their counts. Number 0 is a break."""
        task, turn = TaskContext.get().partitionId(), 0

        def fresh():
            number = itertools.count(1).__next__
            return defaultdict(lambda: defaultdict(number, {b".": 0})), [], 0

        def flush():
            nonlocal turn
            if turn >> TURN_BITS:
                raise ValueError("too many chunks in one task: read the table in smaller partitions")
            tokens = np.concatenate(rows)
            counts = np.bincount(tokens)
            found = sorted((i, lang, word) for lang, words in numbers.items() for word, i in words.items() if i)
            chunk, turn = task << TURN_BITS | turn, turn + 1
            at, langs, words = zip(*found, strict=True) if found else ((), (), ())
            at = np.asarray(at, np.int64)
            none = [None] * len(found)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk] * (len(found) + 1), pa.int64()), pa.array([squeeze(tokens), *none], pa.binary()), pa.array([None, *at], pa.int64()), pa.array([None, *langs], pa.string()),
                    pa.array([None, *words], pa.binary()).view(pa.string()), pa.array([None, *counts[at]], pa.int64()),
                ],
                schema=schema,
            )

        numbers, rows, n = fresh()
        for batch in batches:
            for text, lang in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
                known = numbers[lang]
                for part, broken in _slices(text.as_py().translate(PLAIN), part_bytes):
                    words = part.replace(b".", b" . ").split()
                    row = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
                    rows.append(np.append(row, np.int32(0)) if broken else row)
                    n += len(row)
                    if n >= size and broken:
                        yield flush()
                        numbers, rows, n = fresh()
                        known = numbers[lang]
        if n:
            yield flush()

    return run


def _pair(buckets: int, last: bool):
    schema = pa.schema([("chunk", pa.int64()), ("tokens", pa.binary()), ("bucket", pa.int32()), ("start", pa.int64()), ("l", pa.binary()), ("r", pa.binary()), ("n", pa.binary())])

    def run(chunk: pa.Table, named: pa.Table) -> pa.Table:
        """Replace the grams of a chunk by their names and pair neighbours; all grams without a name are breaks.

        Pairs are numbered by bucket, then by names, so that each bucket gets a run of them, as bytes.
        """
        tokens = spread(chunk["tokens"][0].as_py())
        if "pos" in named.column_names:
            places, names = named["pos"].to_numpy(), named["name"].to_numpy()
        else:
            parts = list(zip(named["start"].to_pylist(), map(spread, named["at"].to_pylist()), map(spread, named["names"].to_pylist()), strict=True))
            places, names = (np.concatenate([np.empty(0, np.int64), *x]) for x in ([s + a for s, a, _ in parts], [n for *_, n in parts]))
        order = np.argsort(names)
        places, names = places[order], names[order]
        own = np.zeros(int(tokens.max(initial=0)) + 1, np.int64)
        own[places] = np.arange(1, len(places) + 1)
        tokens = own[tokens]
        where = np.flatnonzero((tokens[:-1] > 0) & (tokens[1:] > 0))
        keys, place = distinct(tokens[where] * (len(names) + 1) + tokens[where + 1])
        left, right = (names[x - 1] for x in np.divmod(keys.astype(np.int64), len(names) + 1))
        bucket = ((left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(place, minlength=len(keys)) if len(keys) else np.empty(0, np.int64)
        left, right, counts, number = left[order], right[order], counts[order], chunk["chunk"][0].as_py()
        rows = [(number, None, b, x + 1, squeeze(np.diff(left[x:z], prepend=0)), squeeze(right[x:z]), squeeze(counts[x:z])) for b, x, z in cuts_of(bucket[order])]
        if len(keys) and not last:
            grams, numbers = np.zeros(len(tokens), np.int64), np.empty(len(keys), np.int64)
            numbers[order] = np.arange(1, len(keys) + 1)
            grams[where] = numbers[place]
            rows.append((number, squeeze(grams), None, None, None, None, None))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema) if rows else schema.empty_table()

    return run


def _name(buckets: int, least: int):
    schema = pa.schema([("chunk", pa.int64()), ("start", pa.int64()), ("at", pa.binary()), ("names", pa.binary()), ("l", pa.int64()), ("r", pa.int64()), ("f", pa.int64()), ("name", pa.int64())])

    def run(part: pa.Table) -> pa.Table:
        """Add up the pairs of a bucket, name the frequent ones, and tell each chunk the names of its own."""
        lefts = [np.cumsum(spread(x)) for x in part["l"].to_pylist()]
        left, right, n = np.concatenate(lefts), *(np.concatenate([spread(x) for x in part[c].to_pylist()]) for c in ("r", "n"))
        order = np.lexsort((right, left))
        new = np.ones(len(order), bool)
        new[1:] = (left[order][1:] != left[order][:-1]) | (right[order][1:] != right[order][:-1])
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(n[order], starts)
        good = sums >= least
        names = np.full(len(starts), -1)
        names[good] = part["bucket"][0].as_py() + buckets * np.arange(good.sum())
        name = np.empty(len(order), np.int64)
        name[order] = names[np.cumsum(new) - 1]
        ends = np.cumsum([len(x) for x in lefts])
        rows = []
        for chunk, start, at, end in zip(part["chunk"].to_pylist(), part["start"].to_pylist(), ends - [len(x) for x in lefts], ends, strict=True):
            own = name[at:end]
            found = np.flatnonzero(own >= 0)
            if len(found):
                rows.append((chunk, start, squeeze(found), squeeze(own[found])))
        told = pa.Table.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True)) or [()] * 4, schema.types[:4], strict=True)] + [pa.nulls(len(rows), pa.int64())] * 4, schema=schema)
        first = order[starts[good]]
        made = [pa.nulls(len(first), t) for t in schema.types[:4]] + [pa.array(x) for x in (left[first], right[first], sums[good], names[good])]
        # Small batches, as the JVM holds each of them as a whole.
        return pa.Table.from_batches(told.to_batches(max_chunksize=256) + pa.Table.from_arrays(made, schema=schema).to_batches(max_chunksize=BATCH), schema=schema)

    return run


def _words(grams: DataFrame, least: int) -> DataFrame:
    """Words that all chunks together have at least `least` times, with their count f and a name, numbers as small as they can be."""
    names = written(grams.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()), "names1")
    part, place = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    parts = (names.agg(F.max(part)).first()[0] or 0) + 1
    return names.withColumn("name", place * parts + part).drop("id")


def _small(names: DataFrame, *texts: str) -> DataFrame:
    """Broadcast where both the number of rows and the bytes of the texts are small."""
    bounds = names.agg(F.count("*"), *(F.coalesce(F.sum(F.octet_length(x)), F.lit(0)) for x in texts)).first()
    return F.broadcast(names) if bounds[0] <= BROADCAST_ROWS and sum(bounds[1:]) <= BROADCAST_BYTES else names


def phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30, subsumed: int = 80, top: int = 2000, chunk: int = CHUNK) -> DataFrame:
    """The best `top` phrases of 2 to `longest` words of each language: lang, rank, phrase, a, l, r, n, score."""
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    chunks = written(texts.mapInArrow(_chunks(chunk, min(SLICE, 8 * chunk)), WORDS), "words")
    buckets = max(1, chunks.filter("tokens is not null").count())
    words = chunks.filter("word is not null").select("chunk", "pos", "lang", "word", "n")
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    names = _words(words, least)
    told = words.join(_small(names.select("lang", "word", "name"), "lang", "word"), ["lang", "word"]).select(F.col("chunk").alias("of"), "pos", "name")
    none = F.array().cast("array<long>")
    known = names.select("name", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.col("f").alias("a"), none.alias("firsts"), none.alias("lasts"))
    levels = []
    for k in range(2, longest + 1):
        held = chunks.filter("tokens is not null").select("chunk", "tokens")
        chunks = kept(held.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(_pair(buckets, k == longest), SENT), f"pairs{k}", chunks)
        named = written(chunks.filter("l is not null").select("bucket", "chunk", "start", "l", "r", "n").groupBy("bucket").applyInArrow(_name(buckets, least), NAMED), f"named{k}")
        told = named.filter("at is not null").select(F.col("chunk").alias("of"), "start", "at", "names")
        left = known.select(F.col("name").alias("l"), "lang", F.col("phrase").alias("before"), F.concat("firsts", F.array("a")).alias("firsts"))
        right = known.select(F.col("name").alias("r"), F.col("last"), F.concat("lasts", F.array("a")).alias("lasts"))
        names = named.filter("name is not null").select("name", "l", "r", "f")
        known = written(names.join(left, "l").join(right, "r").select("name", "l", "r", "lang", F.concat_ws(" ", "before", "last").alias("phrase"), "last", F.col("f").alias("a"), "firsts", "lasts"), f"known{k}")
        levels.append(known)
    discard(chunks)
    out = None
    for k, level in enumerate(levels, 2):
        # A cut after j words: the count of the prefix of j words and of the suffix of k - j words.
        cuts = [
            F.struct(F.expr(f"(cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0))) div (cast(firsts[{j - 1}] as decimal(20, 0)) + cast(lasts[{k - j - 1}] as decimal(20, 0)))").alias("score"),
                     F.lit(j).alias("after"), F.col("firsts")[j - 1].alias("l"), F.col("lasts")[k - j - 1].alias("r"))
            for j in range(1, k)
        ]
        level = level.withColumn("cut", F.array_min(F.array(*cuts)))
        if k < longest:
            longer = levels[k - 1]
            within = longer.select(F.col("l").alias("name"), F.col("a").alias("f")).unionByName(longer.select(F.col("r").alias("name"), F.col("a").alias("f"))).groupBy("name").agg(F.max("f").alias("within"))
            level = level.join(within, "name", "left").filter(f"within is null or 100 * cast(within as decimal(20, 0)) < {subsumed} * cast(a as decimal(20, 0))")
        level = level.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        out = level if out is None else out.unionByName(level)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = out.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op12_phrases(spark, sf_dir):
    return phrases(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, list_slice(w, i, i + k - 1) AS p FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
), f AS (SELECT lang, k, p, count(*) AS a FROM grams GROUP BY lang, k, p),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k >= 2 AND a >= 30),
cuts AS (
  SELECT c.lang, c.p, c.k, c.a, j, x.a AS l, y.a AS r, ((2000000::HUGEINT * c.a) // (x.a + y.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:c.j] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.j + 1:c.k]
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
inside AS (
  SELECT lang, p[i:i + m - 1] AS p, max(a) AS f FROM (SELECT lang, p, a, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE k > m) GROUP BY 1, 2
), stay AS (SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, p) WHERE f IS NULL OR 100 * f < 80 * a),
ranked AS (SELECT *, array_to_string(p, ' ') AS phrase FROM stay)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked) JOIN totals USING (lang) WHERE rank <= 2000
"""
