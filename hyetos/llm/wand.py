r"""Operator 13: ranked lexical search by Block-Max WAND over an index of posting blocks.

`build_index` deals the documents into shards of about SHARD_WORDS words. In a shard documents are numbered by ascending
id, and every term has blocks of 128 postings: gaps between documents and term frequencies in variable-length bytes, with
a header of first and last document, number of postings and the largest impact in the block. The impact of a posting
needs the number of documents and of all words, so texts are read twice: once to count, once to write.

`search` sends the blocks of query terms of a shard, and the queries, to one task. For each query it moves over headers
only: block boundaries cut the shard into ranges in which each term stands in one block, so the sum of the weighted block
maxima bounds every score in a range. Ranges take the place of single pivots. They are visited from the highest bound
down; a block is decompressed when the first range that it covers is visited, and all ranges whose bound is below the
score of the tenth document found so far are skipped with their blocks still compressed. Scores are exact sums of 64-bit
integers, and a range with a bound equal to the threshold is visited, so ties come out by document id.

Bounds: a shard has at most SHARD_DOCS documents and ends after the document that reaches SHARD_WORDS; queries are dealt
into batches of about BATCH_TERMS terms, each of which meets each shard once; only tables of a counted size are broadcast.

Edge cases: a null text, or one without terms, is no document; a null document id comes last among ties; rows with the
same document id are documents of their own; rows with the same item id are one item with all their terms; a null item id
is an item; other columns are not read; no documents, no items or no match give no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyetos.llm.common import table, written

BLOCK, SHARD_WORDS, SHARD_DOCS, BATCH_TERMS = 128, 1 << 22, 1 << 16, 100_000
#: Bytes of a text that are cut into words at once, and bits of a shard's number for its place in the task.
SLICE, TURN_BITS = 1 << 20, 14
BROADCAST_ROWS, BROADCAST_BYTES = 1 << 19, 64 << 20
_table = bytearray(range(256))
for _c in range(128):
    if not chr(_c).isalnum():
        _table[_c] = ord(" ")
_table[ord("A") : ord("Z") + 1] = b"abcdefghijklmnopqrstuvwxyz"
#: ASCII letters in lower case, digits and all bytes beyond ASCII; the rest as spaces.
PLAIN = bytes(_table)


def _slices(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, slice by slice."""
    plain, at = data.translate(PLAIN), 0
    while at < len(plain):
        end = len(plain) if len(plain) - at <= SLICE else plain.find(b" ", at + SLICE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _text_bytes(column: pa.Array) -> list:
    return column.cast(pa.binary()).to_pylist()


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch the number of texts that have terms, and of terms."""
    for batch in batches:
        sizes = [sum(map(len, _slices(x))) for x in _text_bytes(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array([sum(n > 0 for n in sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], ["docs", "words"])


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, lowest first, all but a number's last byte with the high bit; and where each begins."""
    size = np.ones(len(values), np.int64)
    limit = 7
    while (more := values >> limit > 0).any():
        size += more
        limit += 7
    starts = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[starts[has] + k] = values[has] >> 7 * k & 127 | (size[has] > k + 1) * 128
    return out, starts


def decode(data: np.ndarray) -> np.ndarray:
    """The numbers of `encode`."""
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = (data[starts] & 127).astype(np.int64)
    for k in range(1, int((ends - starts).max(initial=0)) + 1):
        has = ends - starts >= k
        out[has] |= (data[starts[has] + k] & 127).astype(np.int64) << 7 * k
    return out


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the half-open spans, one span after the other."""
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _postings(n_docs: int, n_words: int, shard_words: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn, kind = TaskContext.get().partitionId(), 0, None

        def flush():
            nonlocal turn
            if turn >> TURN_BITS:
                raise ValueError("too many shards in one task: read the table in smaller partitions")
            order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0]))
            lengths = np.array([10 + 90 * docs[i][1] * n_docs // n_words for i in order], np.int64)
            term, tf = (np.concatenate([docs[i][k] for i in order]) for k in (2, 3))
            doc = np.repeat(np.arange(len(docs)), [len(docs[i][2]) for i in order])
            by_term = np.argsort(term, kind="stable")
            term, tf, doc = term[by_term], tf[by_term], doc[by_term]
            begins = np.flatnonzero(np.diff(term, prepend=-1))
            place = np.arange(len(term)) - np.repeat(begins, np.diff(begins, append=len(term)))
            starts = np.flatnonzero(place % block == 0)
            ends = np.append(starts[1:], len(term))
            top = np.maximum.reduceat(impacts(tf, lengths[doc]), starts)
            values = np.empty(2 * len(term), np.int64)
            values[::2], values[1::2] = np.diff(doc, prepend=0), tf
            values[2 * starts] = 0
            data, at = encode(values)
            cut = np.append(at[2 * starts], len(data)).astype(np.int32)
            blocks = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cut), pa.py_buffer(data)])
            words = pa.array(list(number), pa.binary()).view(pa.string()).take(pa.array(term[starts]))
            shard, turn = task << TURN_BITS | turn, turn + 1
            none = pa.nulls(len(starts), pa.list_(kind))
            head = [[None], [0], [len(docs) - 1], [len(docs)], [None], [lengths.tobytes()]]
            columns = [words, doc[starts], doc[ends - 1], ends - starts, top, blocks]
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            arrays = [pa.concat_arrays([pa.array(h, t), c if isinstance(c, pa.Array) else pa.array(c, t)]) for h, c, t in zip(head, columns, types, strict=True)]
            ids = pa.concat_arrays([pa.array([[docs[i][0] for i in order]], pa.list_(kind)), none])
            return pa.RecordBatch.from_arrays([pa.array([shard] * (len(starts) + 1), pa.int64()), *arrays, ids], ["shard", "term", "first", "last", "n", "top", "data", "ids"])

        def fresh():
            number = defaultdict()
            number.default_factory = number.__len__
            return number, [], 0

        number, docs, n = fresh()
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), _text_bytes(batch.column(1)), strict=True):
                counts, size = Counter(), 0
                for words in _slices(text):
                    counts.update(words)
                    size += len(words)
                if not size:
                    continue
                docs.append((doc_id, size, np.fromiter(map(number.__getitem__, counts), np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))))
                n += size
                if n >= shard_words or len(docs) >= SHARD_DOCS:
                    yield flush()
                    number, docs, n = fresh()
        if docs:
            yield flush()

    return run


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS, block: int = BLOCK) -> tuple[DataFrame, int]:
    """The index of all documents, written to the shared folder, and the number of documents that have terms.

    A row is a block: shard, term, first, last, n, top, data. The row of a shard without a term has its documents: their
    ids in `ids` and the lengths m in `data`.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    n_docs, n_words = texts.select("text").mapInArrow(_sizes, "docs long, words long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    kind = texts.schema["id"].dataType.simpleString()
    blocks = texts.mapInArrow(_postings(n_docs, n_words, shard_words, block), f"shard long, term string, first int, last int, n int, top long, data binary, ids array<{kind}>")
    return written(blocks, "postings"), n_docs


class Shard:
    """The blocks of some terms in one shard. `opened` says which are decompressed."""

    def __init__(self, blocks: pa.Table):
        head = blocks.filter(blocks["term"].is_null()).slice(0, 1)
        self.ids, self.lengths = head["ids"][0].values, np.frombuffer(head["data"][0].as_py(), np.int64)
        blocks = blocks.filter(blocks["term"].is_valid())
        terms = blocks["term"].combine_chunks().dictionary_encode()
        code, first = terms.indices.to_numpy(), blocks["first"].to_numpy()
        order = np.lexsort((first, code))
        self.codes = {t: k for k, t in enumerate(terms.dictionary.to_pylist())}
        self.from_ = np.searchsorted(code[order], np.arange(len(self.codes) + 1))
        self.first, self.last, count, self.top = (blocks[x].to_numpy()[order].astype(np.int64) for x in ("first", "last", "n", "top"))
        data = pa.chunked_array(blocks["data"].chunks, pa.binary()).combine_chunks().take(pa.array(order)) if len(order) else pa.array([], pa.binary())
        self.at = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, data.offset * 4).astype(np.int64) if len(data) else np.zeros(1, np.int64)
        self.bytes = np.frombuffer(data.buffers()[2], np.uint8) if len(data) else np.empty(0, np.uint8)
        self.places = np.concatenate([[0], np.cumsum(count)])
        self.doc, self.impact = np.empty(self.places[-1], np.int64), np.empty(self.places[-1], np.int64)
        self.opened = np.zeros(len(order), bool)

    def open(self, blocks: np.ndarray) -> None:
        """Decompress blocks that aren't yet."""
        blocks = blocks[~self.opened[blocks]]
        if not len(blocks):
            return
        self.opened[blocks] = True
        values = decode(self.bytes[spans(self.at[blocks], self.at[blocks + 1])])
        gaps, tf = values[::2], values[1::2]
        sizes = self.places[blocks + 1] - self.places[blocks]
        sums, begins = np.cumsum(gaps), np.cumsum(sizes) - sizes
        docs = sums + np.repeat(self.first[blocks] - sums[begins], sizes)
        to = spans(self.places[blocks], self.places[blocks + 1])
        self.doc[to], self.impact[to] = docs, impacts(tf, self.lengths[docs])

    def search(self, terms: list[str], weights: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best k documents with a score above 0, and their scores."""
        known = [(self.codes[t], w) for t, w in zip(terms, weights, strict=True) if t in self.codes and w > 0]
        if not known:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        codes, weight = np.array(known, np.int64).T
        blocks = spans(self.from_[codes], self.from_[codes + 1])
        weight = np.repeat(weight, self.from_[codes + 1] - self.from_[codes])
        edges = np.unique(np.concatenate([self.first[blocks], self.last[blocks] + 1]))
        begin, end = np.searchsorted(edges, self.first[blocks]), np.searchsorted(edges, self.last[blocks] + 1)
        steps = np.zeros(len(edges), np.int64)
        np.add.at(steps, begin, weight * self.top[blocks])
        np.subtract.at(steps, end, weight * self.top[blocks])
        bound = np.cumsum(steps)[:-1]
        order = np.argsort(-bound, kind="stable")
        score, added = np.zeros(len(self.lengths), np.int64), np.zeros(len(blocks), bool)
        best, least, at, some = np.empty(0, np.int64), 1, 0, 4
        while at < len(order) and bound[order[at]] >= least:
            ranges = order[at : at + some]
            ranges = ranges[bound[ranges] >= least]
            at, some = at + some, 2 * some
            visited = np.zeros(len(edges) + 1, np.int64)
            visited[ranges + 1] = 1
            visited = np.cumsum(visited)
            needed = np.flatnonzero((visited[end] > visited[begin]) & ~added)
            added[needed] = True
            self.open(blocks[needed])
            lo, hi = self.places[blocks[needed]], self.places[blocks[needed] + 1]
            places = spans(lo, hi)
            np.add.at(score, self.doc[places], self.impact[places] * np.repeat(weight[needed], hi - lo))
            best = np.concatenate([best, spans(edges[ranges], edges[ranges + 1])])
            best = best[score[best] >= least]
            if len(best) >= k:
                least = max(1, int(np.partition(score[best], len(best) - k)[len(best) - k]))
                best = best[score[best] >= least]
        best = best[np.lexsort((best, -score[best]))[:k]]
        return best, score[best]


def _search(k: int):
    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        shard = Shard(blocks)
        found = [shard.search(*x, k) for x in zip(queries["terms"].to_pylist(), queries["weights"].to_pylist(), strict=True)]
        docs, scores = (np.concatenate([np.empty(0, np.int64), *(x[j] for x in found)]) for j in (0, 1))
        items = queries["item"].combine_chunks().take(pa.array(np.repeat(np.arange(len(found)), [len(d) for d, _ in found]).astype(np.int64)))
        return pa.Table.from_arrays([items, shard.ids.take(pa.array(docs)), pa.array(scores, pa.int64())], ["item", "id", "score"])

    return run


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(set().union(*map(set, _slices(x)))) for x in _text_bytes(batch.column(1))]
        items = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([items, pa.array([t for x in found for t in x], pa.binary()).view(pa.string())], ["item", "term"])


def search(
    index: DataFrame, n_docs: int, items: DataFrame, *, item_col: str = "item_id", text_col: str = "text", k: int = 10, batch_terms: int = BATCH_TERMS,
) -> DataFrame:
    """The best k documents of each item: item_id, rank, doc_id, score."""
    texts = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).filter("text is not null")
    kind = texts.schema["item"].dataType.simpleString()
    asked = written(texts.mapInArrow(_terms, f"item {kind}, term string").distinct(), "asked")
    pairs, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()
    small = (lambda df: F.broadcast(df)) if pairs <= BROADCAST_ROWS and size <= BROADCAST_BYTES else (lambda df: df)
    batches = max(1, -(-pairs // batch_terms))
    asked = asked.withColumn("batch", F.pmod(F.xxhash64("item"), F.lit(batches)).cast("int"))
    blocks = index.filter("term is not null")
    held = blocks.join(small(asked.select("term").distinct()), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weighted = asked.join(held, "term").withColumn("w", F.floor(1000 * F.log(F.lit(2 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long"))
    queries = weighted.groupBy("batch", "item").agg(F.collect_list(F.struct("term", "w")).alias("q")).select("batch", "item", F.col("q.term").alias("terms"), F.col("q.w").alias("weights"))
    queries = written(queries, "queries")
    shards = index.filter("term is null").withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    hits = blocks.join(small(asked.select("term", "batch").distinct()), "term").select("shard", "batch", "term", "first", "last", "n", "top", "data", "ids")
    hits = hits.unionByName(shards)
    sent = shards.select(F.col("shard").alias("to"), "batch").join(small(queries), "batch").select("to", F.col("batch").alias("part"), "item", "terms", "weights")
    found = hits.groupBy("shard", "batch").cogroup(sent.groupBy("to", "part")).applyInArrow(_search(k), f"item {kind}, id {index.schema['ids'].dataType.elementType.simpleString()}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(F.col("item").alias(item_col), "rank", F.col("id").alias("doc_id"), "score")


def op13_block_max_wand(spark, sf_dir):
    index, n_docs = build_index(table(spark, sf_dir, "documents"))
    return search(index, n_docs, table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, rid, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS rid FROM documents)
), tf AS (SELECT rid, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
lens AS (SELECT rid, count(*) AS n FROM t GROUP BY rid), stats AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM lens),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), w AS (SELECT item_id, term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM q JOIN df USING (term), stats),
m AS (SELECT rid, 10 + (90 * n * big_n) // big_l AS m FROM lens, stats),
s AS (SELECT item_id, rid, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM w JOIN tf USING (term) JOIN m USING (rid) GROUP BY item_id, rid)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
) WHERE rank <= 10
"""
