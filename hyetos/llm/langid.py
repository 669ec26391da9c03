"""Operator 1: language identification, word first.

Words of the learning documents are counted for each language. A word of the dictionary adds its smoothed log
frequency under every language. A word outside is judged by its longest character strings that are known: strings of
four characters (with word boundaries), else three, two, one; it adds the mean log frequency of those. The language
with the largest sum wins, ties by name; the score is its share after normalisation. A word is a run of letters of the
lower-cased text.

All words of all learning documents are counted, and all of them feed the character strings. The log frequencies of
the commonest words (at most HOT, so that they are no hot keys) travel with the tasks; all other words of a document
are joined with theirs in a shuffle, and the sums meet in the document. Which way a word goes changes no result.
Counts leave a task pre-summed, so a hot language is no hot key either.

Edge cases: a null text, or one without a letter, is `und` with score 0, as is every text when nothing could be
learned; null languages teach nothing; a null id counts as the empty text in the split; repeated rows are judged
alike; the carried columns pass through, and of columns that clash with the results the operator's values stay; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyetos.llm.chunks import distinct, runs
from hyetos.llm.common import kept, table

LONGEST = 4
#: Words whose log frequencies are broadcast, at most; characters that are read, and tokens that are counted, at once.
HOT, PIECE, CHUNK = 1 << 17, 1 << 21, 2_000_000


def letters() -> np.ndarray:
    """Of every code point, whether it is a letter."""
    return np.frombuffer(bytes(chr(k).isalpha() for k in range(0x110000)), bool)


class _Words:
    """Words of texts: gathered until `size` is enough, then their distinct ones, each text's, and how often they occur."""

    def __init__(self):
        self.letter = letters()
        self.clear()

    def clear(self) -> None:
        self.size, self.waiting, self.texts, self.pieces, self.n_texts = 0, 0, [], [], 0

    def add(self, text: str | None) -> None:
        self.texts.append((text or "").lower())
        self.waiting += len(self.texts[-1])
        if self.waiting >= PIECE:
            self._read()

    def _read(self) -> None:
        joined = " ".join(self.texts)
        units = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, ends, h = runs(units, self.letter[units])
        texts = np.searchsorted(np.cumsum([len(t) + 1 for t in self.texts]), starts, "right") + self.n_texts
        self.pieces.append((joined, starts, ends, h, texts))
        self.n_texts, self.size, self.waiting, self.texts = self.n_texts + len(self.texts), self.size + len(h), 0, []

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[np.ndarray], list[str]]]:
        """(hash of every distinct word, the word of each token, its text, what spells words)."""
        if self.texts:
            self._read()
        found, place = distinct(np.concatenate([x[3] for x in self.pieces]))
        first = np.empty(len(found), np.int64)
        first[place[::-1]] = np.arange(len(place))[::-1]
        piece = np.repeat(np.arange(len(self.pieces)), [len(x[3]) for x in self.pieces])[first]
        starts, ends = (np.concatenate([x[k] for x in self.pieces])[first] for k in (1, 2))
        joined = [x[0] for x in self.pieces]
        texts = np.concatenate([x[4] for x in self.pieces])
        self.clear()
        spell = lambda at: [joined[p][a:z] for p, a, z in zip(piece[at].tolist(), starts[at].tolist(), ends[at].tolist(), strict=True)]
        return found, place, texts, spell


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, langs = _Words(), []

    def rows() -> Iterator[pa.RecordBatch]:
        names = sorted(set(langs))
        number = {x: k for k, x in enumerate(names)}
        lang = np.array([number[x] for x in langs], np.int64)
        langs.clear()
        _, place, texts, spell = words.take()
        found, n = np.unique(place * len(names) + lang[texts], return_counts=True)
        for part in np.array_split(np.arange(len(found)), len(found) // 100_000 + 1):
            word, of = np.divmod(found[part], len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(of)), pa.array(spell(word), pa.string()), pa.array(n[part].astype(np.int64))], ["lang", "key", "n"])

    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            words.add(text), langs.append(lang)
            if words.size >= CHUNK:
                yield from rows()
    if langs:
        yield from rows()


def _windows(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of every string of `size` characters of the words with their boundaries."""
    units = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    word = np.repeat(np.arange(len(words)), sizes)
    at = np.flatnonzero(np.arange(len(units)) + size <= np.repeat(np.cumsum(sizes), sizes))
    h = np.full(len(at), size, np.uint64)
    for k in range(size):
        h = (h ^ units[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return word[at], h.view(np.int64)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []

    def rows(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        lang, size, key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((lang, key))
        lang, size, key, n = lang[order], size[order], key[order], n[order]
        cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (lang[1:] != lang[:-1])]))
        return lang[cuts], size[cuts], key[cuts], np.add.reduceat(n, cuts)

    names: list[str] = []
    place: dict[str, int] = {}

    def put() -> Iterator[pa.RecordBatch]:
        lang, size, key, n = rows(held)
        held.clear()
        for a in range(0, len(n), 100_000):
            z = a + 100_000
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(lang[a:z])), pa.array(size[a:z], pa.int32()), pa.array(key[a:z]), pa.array(n[a:z])], ["lang", "size", "key", "n"])

    for batch in batches:
        langs, words, n = (batch.column(c).to_pylist() for c in ("lang", "key", "n"))
        for x in langs:
            if x not in place:
                place[x] = len(names)
                names.append(x)
        lang, n = np.array([place[x] for x in langs], np.int64), np.array(n, np.int64)
        for size in range(1, LONGEST + 1) if words else ():
            word, key = _windows(words, size)
            held.append(rows([(lang[word], np.full(len(key), size), key, n[word])]))
        if sum(len(x[0]) for x in held) > 2_000_000:
            held[:] = [rows(held)]
            if len(held[0][0]) > 1_000_000:
                yield from put()
    if held:
        yield from put()


def _ask_grams(*sizes: int):
    """The strings of these sizes of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            for size in sizes if words else ():
                word, key = _windows(words, size)
                yield pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(word)), pa.array(np.full(len(key), size), pa.int32()), pa.array(key)], ["word", "size", "key"])

    return run


def _by_key(counts: DataFrame, *also: str) -> DataFrame:
    """A row for each key with its counts by language, from partial counts."""
    dealt = counts.repartition("key").groupBy("key", "lang", *also).agg(F.sum("n").alias("n"))
    return dealt.groupBy("key", *also).agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))


@dataclass
class Model:
    """Words and character strings with their counts by language, the sums of these, and how many words and strings there are."""

    words: DataFrame
    grams: DataFrame
    word_sums: dict[str, int]
    gram_sums: dict[tuple[str, int], int]
    n_words: int
    n_grams: int

    @property
    def langs(self) -> list[str]:
        return sorted(self.word_sums)

    def word_logs(self, words: DataFrame) -> DataFrame:
        """(key, logs) of rows of `words`."""
        return words.select("key", F.array(*[F.log((F.coalesce(F.col("by")[x], F.lit(0)) + 0.5) / F.lit(self.word_sums[x] + 0.5 * self.n_words + 1)).cast("float") for x in self.langs]).alias("logs"))

    def gram_logs(self) -> DataFrame:
        """(key, size, logs) of every known string."""
        total = lambda x: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for k in range(1, LONGEST + 1) for v in (k, float(self.gram_sums.get((x, k), 0)))]), F.col("size")), F.lit(0.0))
        return self.grams.select("key", "size", F.array(*[F.log((F.coalesce(F.col("by")[x], F.lit(0)) + 0.5) / (total(x) + (0.5 * self.n_grams + 1))).cast("float") for x in self.langs]).alias("logs"))

    def backed(self, new: DataFrame) -> DataFrame:
        """(key, logs) of unknown words: the mean of their longest known strings, zeros if none is known."""
        def judged(words: DataFrame, *sizes: int) -> DataFrame:
            found = words.mapInArrow(_ask_grams(*sizes), "word string, size int, key long").join(self.gram_logs().filter(F.col("size").isin(*sizes)).drop("size"), "key")
            means = found.groupBy("word", "size").agg(F.array(*[F.avg(F.col("logs")[k]).cast("float") for k in range(len(self.langs))]).alias("logs"))
            return means if len(sizes) == 1 else means.groupBy("word").agg(F.max_by("logs", "size").alias("logs"))

        longest = kept(judged(new, LONGEST).select("word", "logs"), "longest")
        rest = judged(new.join(longest, "word", "left_anti"), *range(1, LONGEST))
        return longest.unionByName(rest.select("word", "logs")).select(F.col("word").alias("key"), "logs")


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model from the documents with a text and a language."""
    texts = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    words = kept(_by_key(texts.mapInArrow(_count_words, "lang string, key string, n long")), "words")
    each = words.select("key", F.explode("by").alias("lang", "n"))
    grams = kept(_by_key(each.select("lang", "key", "n").mapInArrow(_count_grams, "lang string, size int, key long, n long"), "size"), "grams")
    word_sums = {r["lang"]: r["n"] for r in each.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    gram_sums = {(r["lang"], r["size"]): r["n"] for r in grams.select("size", F.explode("by").alias("lang", "n")).groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    return Model(words, grams, word_sums, gram_sums, words.count(), grams.count())


def _hot(model: Model) -> tuple[int, list]:
    """(c, rows): the words that occur c times or more, at most HOT of them, with their log frequencies."""
    bins = model.words.groupBy(F.floor(F.log2("n") * 4).alias("bin")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()
    least, total = 1 << 62, 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        total += r["words"]
        if total > HOT:
            break
        least = r["least"]
    return least, model.word_logs(model.words.filter(F.col("n") >= least)).collect() if least < 1 << 62 else []


def _partial(hot, n_langs: int):
    """Of every document the sums over its common words (kind 0), and its other words with their counts (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = (np.frombuffer(x, t) for x, t in zip(hot.value, (np.uint64, np.float32), strict=True))
        logs = logs.reshape(-1, n_langs)
        words, carried, doc = _Words(), [], TaskContext.get().partitionId() << 40

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal doc
            docs = pa.Table.from_batches(carried)
            carried.clear()
            found, place, texts, spell = words.take()
            at = np.minimum(np.searchsorted(keys, found), max(0, len(keys) - 1))
            known = keys[at] == found if len(keys) else np.zeros(len(found), bool)
            ids, empty = doc + np.arange(len(docs)), lambda t, n: pa.nulls(n, t)
            sums = [np.bincount(texts, np.where(known, logs[at, k], 0)[place], len(docs)) if len(keys) else np.zeros(len(docs)) for k in range(n_langs)]
            sums = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(sums, 1).ravel() if n_langs else np.zeros(0)), n_langs).cast(pa.list_(pa.float64())) if n_langs else pa.array([[]] * len(docs), pa.list_(pa.float64()))
            n_words = np.bincount(texts, minlength=len(docs))
            names = [*docs.schema.names, "kind", "doc", "n", "sums", "key"]
            columns = [*docs.columns, pa.array(np.zeros(len(docs), np.int32)), pa.array(ids), pa.array(n_words), sums, empty(pa.string(), len(docs))]
            yield from pa.Table.from_arrays(columns, names).to_batches(max_chunksize=10_000)
            rare = ~known[place]
            pair, n = np.unique(texts[rare] * max(1, len(found)) + place[rare], return_counts=True)
            for part in np.array_split(np.arange(len(pair)), len(pair) // 100_000 + 1):
                of, word = np.divmod(pair[part], max(1, len(found)))
                columns = [*[empty(f.type, len(part)) for f in docs.schema], pa.array(np.ones(len(part), np.int32)), pa.array(ids[of]), pa.array(n[part].astype(np.int64)), empty(pa.list_(pa.float64()), len(part)), pa.array(spell(word), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)
            doc += len(docs)

        for batch in batches:
            for part in (batch.slice(a, 100) for a in range(0, len(batch), 100)):
                for text in part.column("text").to_pylist():
                    words.add(text)
                carried.append(part.drop_columns(["text"]))
                if words.size >= CHUNK:
                    yield from rows()
        if carried:
            yield from rows()

    return run


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", carry: list[str]) -> DataFrame:
    """The `carry` columns with lang_pred and score."""
    spark, langs = docs.sparkSession, model.langs
    carry = [c for c in carry if c not in ("lang_pred", "score")]
    shipped = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)], F.col(text_col).cast("string").alias("text"))
    least, hot = _hot(model)
    packed = _packed_logs(hot, len(langs))
    kinds = ", ".join([*[f"{c} {t}" for c, t in shipped.dtypes[:-1]], "kind int", "doc long", "n long", "sums array<double>", "key string"])
    sums = kept(shipped.mapInArrow(_partial(spark.sparkContext.broadcast(packed), len(langs)), kinds), "sums")
    judged = sums.filter("kind = 0").drop("key", "kind")
    if langs:
        rare = sums.filter("kind = 1").select("doc", "key", "n")
        known = model.word_logs(model.words.filter(F.col("n") < least))
        found = rare.join(known, "key", "left")
        found = kept(found, "rare")
        new = kept(found.filter("logs is null").select(F.col("key").alias("word")).distinct(), "new")
        other = found.filter("logs is null").drop("logs").join(model.backed(new), "key")
        every = found.filter("logs is not null").unionByName(other)
        parts = every.groupBy("doc").agg(F.array(*[F.sum(F.col("n") * F.col("logs")[k].cast("double")) for k in range(len(langs))]).alias("more"))
        z = F.zip_with("sums", F.coalesce("more", F.array_repeat(F.lit(0.0), len(langs))), lambda a, b: a + b)
        judged = judged.join(parts, "doc", "left").withColumn("z", z)
        top = F.array_max("z")
        best, share = F.array_position("z", top), F.lit(1.0) / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - top))
        names = F.array(*map(F.lit, langs))
        spoken = F.col("n") > 0
        judged = judged.withColumns({"lang_pred": F.when(spoken, F.element_at(names, best.cast("int"))).otherwise("und"), "score": F.when(spoken, share).otherwise(0.0)})
    else:
        judged = judged.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    return judged.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)], "lang_pred", "score")


def _packed_logs(hot: list, n_langs: int) -> tuple[bytes, bytes]:
    """Hashes of words in order, and their log frequencies, as plain bytes."""
    words = [r["key"] for r in hot]
    units = np.frombuffer(" ".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    _, _, h = runs(units, units != ord(" "))
    order = np.argsort(h)
    logs = np.array([r["logs"] for r in hot], np.float32).reshape(-1, n_langs) if hot else np.zeros((0, n_langs), np.float32)
    return h[order].tobytes(), logs[order].tobytes()


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    return identify(docs, learn(docs.filter("not held_out")), carry=["doc_id", "held_out"])
