"""Operator 4: scoring by a hierarchical Pitman-Yor language model.

Model. Each preceding word is a restaurant whose dishes are the next words; all restaurants share one parent, the
restaurant of single words, whose parent is uniform over all training words and one unknown word. Every word of the
training documents is a dish and a context of its own. Discounts come from how many dishes have one and two customers.

Sampling. The state is the number of tables of every (context, word). A dish with one customer has one table, so only
dishes with more are kept. In a round every restaurant is swept LOCAL times given the parent's probabilities, each
sweep in GROUPS of dishes one after the other, then the parent's tables are drawn given its customers, which are the
tables below. Draws are exact up to 64 customers and Metropolis-Hastings steps above (pitman_yor.draw_tables). After
`burn` rounds the predictive probabilities of `samples` rounds are averaged.

Scale. Documents are packed into chunks of about CHUNK tokens and become numbers once. A chunk sends its distinct words
to buckets by hash, which count them and number them, frequent ones low; then its distinct pairs, with their counts, to
buckets of restaurants. A bucket merges the pairs of all chunks, keeps the state of its restaurants, and exchanges with
the buckets of words: tables one way, the parent's seating the other. All of these are groups of about BUCKET entries,
whose number grows with the input; a context of more than SLICE tokens is dealt by its next word over several buckets,
which tell each other their tables. Nothing that grows with the input is broadcast or collected.
Words are known by 64-bit hashes: with 10^9 different words the chance that any two share one is about 3 %, and then
only those two are confused.

Edge cases: a null or empty text is one end token; without learning documents all words are unknown and the model is
uniform; a null id counts as the empty text in the split; rows with the same id and text score alike and stay; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyetos.llm.chunks import cuts_of, distinct, runs, spread, squeeze
from hyetos.llm.common import discard, kept, table
from hyetos.llm.pitman_yor import discount_of, draw_tables, stirling

STRENGTH = 1.0
#: Tokens of a chunk of documents; entries of a bucket; tokens of a context that one bucket holds.
CHUNK, BUCKET, SLICE = 2_000_000, 1_500_000, 500_000
#: Sweeps of a restaurant in a round, and parts of a sweep that are drawn one after the other.
LOCAL, GROUPS = 2, 4
#: The context at the start of a text; words are numbered from 1.
START = 0

CHUNKS = "chunk long, docs array<long>, held array<boolean>, sizes binary, words binary, codes binary"
NUMBERED = "chunk long, docs array<long>, held array<boolean>, sizes binary, ids binary, seen binary, codes binary"


def _table(schema: str, rows: list[dict]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    return pa.Table.from_pylist(rows, pa.schema([(n, kinds[t]) for n, t in (c.split(" ") for c in schema.split(", "))]))


def _batches(schema: str, rows: list[dict]) -> Iterator[pa.RecordBatch]:
    yield from _table(schema, rows).to_batches()


#: What bytes belong to words; the hash of the end.
IN_WORD = np.array([x not in b"\t\n\x0b\x0c\r " for x in range(256)])
END = np.uint64(0)
#: Bytes of text that are hashed together.
PIECE = 1 << 21


def _hashed(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of these texts, each with its end, and how many each text has."""
    units = np.frombuffer(b"".join(x for t in texts for x in ((t or b"").lower(), b" ")), np.uint8)
    starts, _, h = runs(units, IN_WORD[units])
    sizes = np.diff(np.searchsorted(starts, np.cumsum([0, *[len(t or b"") + 1 for t in texts]])))
    return np.insert(h, np.cumsum(sizes), END), sizes + 1


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk of documents: its distinct words' hashes in order, and the number of each token's word."""
    chunk, size, docs, held, texts, waiting, done = TaskContext.get().partitionId() << 32, 0, [], [], [], 0, []

    def row() -> Iterator[pa.RecordBatch]:
        words, codes = distinct(np.concatenate([h for h, _ in done]))
        sizes = np.concatenate([n for _, n in done])
        yield from _batches(CHUNKS, [{"chunk": chunk, "docs": docs, "held": held, "sizes": squeeze(sizes), "words": words.tobytes(), "codes": squeeze(codes)}])

    for batch in batches:
        for doc, out, text in zip(batch.column("doc").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            docs.append(doc), held.append(out), texts.append(text)
            waiting += len(text or b"")
            if waiting >= PIECE:
                done.append(_hashed(texts))
                size, texts, waiting = size + len(done[-1][0]), [], 0
                if size >= CHUNK:
                    yield from row()
                    chunk, size, docs, held, done = chunk + 1, 0, [], [], []
    if texts:
        done.append(_hashed(texts))
    if docs:
        yield from row()


def _learns(row: dict, sizes: np.ndarray) -> np.ndarray:
    """Of every token of a chunk, whether the model learns from it."""
    return np.repeat(~np.array(row["held"], bool), sizes)


WORDS = "bucket int, chunk long, words binary, n binary"


def _ask_words(buckets: int):
    """The words of every chunk with their training counts, by bucket; buckets are ranges of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, codes = np.frombuffer(row["words"], np.uint64), spread(row["codes"])
                n = np.bincount(codes[_learns(row, spread(row["sizes"]))], minlength=len(words))
                where = (words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                yield from _batches(WORDS, [{"bucket": b, "chunk": row["chunk"], "words": words[a:z].tobytes(), "n": squeeze(n[a:z])} for b, a, z in cuts_of(where)])

    return run


NAMES = "bucket int, chunk long, ids binary, seen binary, types long, tokens long"


def _number(buckets: int):
    """Numbers the words of a bucket, frequent ones first, and tells each chunk those of its words and their counts."""

    def run(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        parts = [np.frombuffer(r["words"], np.uint64) for r in rows]
        words, place = distinct(np.concatenate(parts))
        n = np.bincount(place, np.concatenate([spread(r["n"]) for r in rows]), len(words)).astype(np.int64)
        ids = np.empty(len(words), np.int64)
        ids[np.argsort(-n, kind="stable")] = np.arange(len(words)) * buckets + rows[0]["bucket"] + 1
        at, out = 0, []
        for r, part in zip(rows, parts, strict=True):
            mine = place[at : at + len(part)]
            at += len(part)
            out.append({"bucket": r["bucket"], "chunk": r["chunk"], "ids": squeeze(ids[mine]), "seen": squeeze(n[mine]), "types": 0, "tokens": 0})
        out[0] |= {"types": int((n > 0).sum()), "tokens": int(n.sum())}
        return _table(NAMES, out)

    return run


def _name(starts: int):
    """The chunk with the numbers and counts of its words, in order of the numbers, in place of their hashes; first is the start."""

    def run(chunk: pa.Table, names: pa.Table) -> pa.Table:
        told = names.sort_by("bucket").to_pylist()
        row = chunk.to_pylist()[0]
        ids, seen = (np.concatenate([spread(x[c]) for x in told]) for c in ("ids", "seen"))
        order = np.argsort(ids)
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(1, len(ids) + 1)
        named = {"ids": np.append(START, ids[order]), "seen": np.append(starts, seen[order]), "codes": rank[spread(row["codes"])]}
        return _table(NUMBERED, [{**{c: row[c] for c in ("chunk", "docs", "held", "sizes")}, **{c: squeeze(x) for c, x in named.items()}}])

    return run


def _chunk_pairs(row: dict, buckets: int):
    """Of a chunk: bucket, context, its count, word and training count of every distinct pair in order of those, and each token's place among them."""
    sizes, codes, ids, seen = (spread(row[c]) for c in ("sizes", "codes", "ids", "seen"))
    before = np.concatenate([[0], codes[:-1]])
    before[np.cumsum(sizes) - sizes] = 0
    found, place = distinct(before * len(ids) + codes)
    n = np.bincount(place[_learns(row, sizes)], minlength=len(found))
    c, w = np.divmod(found.astype(np.int64), len(ids))
    context, count, word = ids[c], seen[c], ids[w]
    mixed = (context * 0x9E3779B1 + word % (count // SLICE + 1) * 0x85EBCA6B & 0xFFFFFFFF) * 0xC2B2AE35 & 0xFFFFFFFF
    bucket = (mixed ^ mixed >> 15) % buckets
    order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return bucket[order], context[order], count[order], word[order], n[order], rank[place]


PAIRS = "bucket int, chunk long, contexts binary, counts binary, runs binary, words binary, n binary"


def _ask_pairs(buckets: int):
    """The distinct pairs of every chunk, by bucket of restaurants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bucket, context, count, word, n, _ = _chunk_pairs(row, buckets)
                for b, a, z in cuts_of(bucket):
                    first = a + np.flatnonzero(np.diff(context[a:z], prepend=-1))
                    yield from _batches(PAIRS, [{"bucket": b, "chunk": row["chunk"], "contexts": squeeze(context[first]), "counts": squeeze(count[first]), "runs": squeeze(np.diff(first, append=z)), "words": squeeze(word[a:z]), "n": squeeze(n[a:z])}])

    return run


def _merge(rows: list[dict]):
    """Of a bucket: its contexts, their counts, its words, and of every pair its place of context and word and its training count; and each asked pair's place."""
    each = [spread(r["contexts"]) for r in rows]
    contexts, c = distinct(np.concatenate(each))
    counts = np.zeros(len(contexts), np.int64)
    counts[c] = np.concatenate([spread(r["counts"]) for r in rows])
    words, w = distinct(np.concatenate([spread(r["words"]) for r in rows]))
    found, place = distinct(np.repeat(c, np.concatenate([spread(r["runs"]) for r in rows])) * len(words) + w)
    n = np.bincount(place, np.concatenate([spread(r["n"]) for r in rows]), len(found)).astype(np.int64)
    return contexts.astype(np.int64), counts, words.astype(np.int64), *np.divmod(found.astype(np.int64), len(words)), n, place


#: A message about words or contexts: from a bucket of restaurants to one of words, or back.
MESSAGE = "kind int, bucket int, peer int, places binary, values binary, more array<binary>"
#: The state of a bucket's restaurants. Every dish in it has more than one customer.
STATE = "kind int, bucket int, contexts binary, counts binary, ones binary, words binary, c binary, w binary, n binary, t binary, t_sum binary, free array<binary>, once long, twice long"
TABLES, CONTEXTS, SINGLES, RESTAURANTS, SEATED, PAIRED = range(6)
BOTH = STATE + ", peer int, places binary, values binary, more array<binary>"


def _messages(kind: int, bucket: int, ids: np.ndarray, values: np.ndarray, parts: int) -> list[dict]:
    """What a bucket says of some words, for each bucket of words."""
    order = np.lexsort((ids, ids % parts))
    ids, values = ids[order], values[order]
    return [{"kind": kind, "bucket": bucket, "peer": p, "places": squeeze(ids[a:z] // parts), "values": squeeze(values[a:z])} for p, a, z in cuts_of(ids % parts)]


def _told(rows: list[dict], kind: int, ids: np.ndarray, parts: int, column=lambda r: np.frombuffer(r["values"], np.float64)) -> np.ndarray:
    """The answers to `_messages` about these words, in their order."""
    out = np.zeros(len(ids))
    order = np.lexsort((ids, ids % parts))
    found = sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["peer"])
    out[order] = np.concatenate([column(r) for r in found]) if found else 0.0
    return out


def _sums(bucket: int, words: np.ndarray, w: np.ndarray, t: np.ndarray, contexts: np.ndarray, counts: np.ndarray, tables: np.ndarray, parts: int) -> list[dict]:
    """Messages with the tables of every word and of every context that other buckets have a part of."""
    wide = counts >= SLICE
    return _messages(TABLES, bucket, words, np.bincount(w, t, len(words)).astype(np.int64), parts) + _messages(CONTEXTS, bucket, contexts[wide], tables[wide], parts)


def _found(parts: int):
    """The first state of a bucket's restaurants, with a table for each dish, and its first messages."""

    def run(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        bucket = rows[0]["bucket"]
        contexts, counts, words, c, w, n, place = _merge(rows)
        paired = {"kind": PAIRED, "bucket": bucket, **{k: squeeze(v) for k, v in {"counts": counts, "words": words, "c": c, "w": w, "n": n, "t": place}.items()}}
        paired |= {"places": squeeze(np.array([r["chunk"] for r in rows])), "values": squeeze(np.array([spread(r["runs"]).sum() for r in rows]))}
        ones = np.bincount(c[n == 1], minlength=len(contexts))
        more = n > 1
        dishes, at = distinct(w[more])
        dishes = dishes.astype(np.int64)
        state = {
            "kind": RESTAURANTS, "bucket": bucket, "contexts": squeeze(contexts), "counts": squeeze(counts), "ones": squeeze(ones), "words": squeeze(words[dishes]), "c": squeeze(c[more]), "w": squeeze(at),
            "n": squeeze(n[more]), "t": squeeze(np.ones(int(more.sum()), np.int64)), "t_sum": squeeze(np.zeros(int(more.sum()), np.int64)), "free": [], "once": int((n == 1).sum()), "twice": int((n == 2).sum()),
        }
        single = np.bincount(w[n == 1], minlength=len(words))
        tables = ones + np.bincount(c[more], minlength=len(contexts))
        messages = _messages(SINGLES, bucket, words, single, parts) + _sums(bucket, words[dishes], at, np.ones(len(at), np.int64), contexts, counts, tables, parts)
        return _table(BOTH, [paired, state, *messages])

    return run


class _Restaurants:
    """A bucket's state with what the buckets of words say."""

    def __init__(self, rows: list[dict], parts: int, discount: float):
        state = next(r for r in rows if r["kind"] == RESTAURANTS)
        self.bucket, self.free, self.discount, self.rows, self.parts = state["bucket"], list(state["free"] or []), discount, rows, parts
        self.contexts, self.counts, self.ones, self.words, self.c, self.w, self.n, self.t, self.t_sum = (spread(state[k]) for k in ("contexts", "counts", "ones", "words", "c", "w", "n", "t", "t_sum"))
        wide = self.counts >= SLICE
        self.others = np.zeros(len(self.contexts))
        self.others[wide] = _told(rows, CONTEXTS, self.contexts[wide], parts)
        if wide.any():  # what is told includes the bucket's own
            self.others -= np.where(wide, self.tables(), 0)

    def tables(self) -> np.ndarray:
        return self.ones + np.bincount(self.c, self.t, len(self.contexts))

    def keep(self) -> None:
        """The tables as they are become a sample."""
        self.t_sum = self.t_sum + self.t
        share = (STRENGTH + self.discount * (self.tables() + self.others)) / (STRENGTH + self.counts)
        self.free.append(share.astype(np.float32).tobytes())

    def sweep(self, p: np.ndarray, rng: np.random.Generator) -> None:
        logs = stirling(self.discount)
        for k in range(LOCAL):
            part = rng.integers(0, GROUPS, len(self.n))
            for g in range(GROUPS):
                at = np.flatnonzero((part == g) & ((self.n <= len(logs) - 1) | (k == 0)))
                if len(at):
                    others = (self.tables() + self.others)[self.c[at]] - self.t[at]
                    self.t[at] = draw_tables(self.n[at], p[at], others, STRENGTH, self.discount, rng, logs, self.t[at])

    def row(self) -> dict:
        names = ("contexts", "counts", "ones", "words", "c", "w", "n", "t", "t_sum")
        return {"kind": RESTAURANTS, "bucket": self.bucket, **{k: squeeze(getattr(self, k)) for k in names}, "free": self.free, "once": 0, "twice": 0}


def _draw(parts: int, discount: float, rest: float, total: float, seed: int, keep: bool):
    """A round of the restaurants of a bucket; `keep` first makes a sample of what the round before left."""

    def run(rows: pa.Table) -> pa.Table:
        own = _Restaurants(rows.to_pylist(), parts, discount)
        if keep:
            own.keep()
        p = (_told(own.rows, TABLES, own.words, parts) + rest) / total
        own.sweep(p[own.w], np.random.default_rng([seed, own.bucket]))
        return _table(BOTH, [own.row(), *_sums(own.bucket, own.words, own.w, own.t, own.contexts, own.counts, own.tables(), parts)])

    return run


SEATS = "kind int, peer int, customers binary, seats binary, more array<binary>, n_customers long, n_seats long, once long, twice long, bucket int, values binary"


def _seat(discount: float, base: float, seated: int, seed: int, keep: bool):
    """A draw of the parent's tables for the words of a bucket, and answers to the buckets of restaurants."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        peer, state = rows[0]["peer"], next((r for r in rows if r["kind"] == SEATED), None)
        said = [(r, spread(r["places"]), spread(r["values"])) for r in rows if r["kind"] != SEATED]
        most = 1 + max((int(x.max()) for r, x, _ in said if r["kind"] == SINGLES), default=-1)
        if state is None:  # the first round; there is a message about every word
            single, seats, more = np.zeros(most), np.zeros(most, np.int64), []
            for r, places, values in said:
                if r["kind"] == SINGLES:
                    np.add.at(single, places, values)
        else:
            single, seats, more = spread(state["customers"]).astype(float), spread(state["seats"]), list(state["more"] or [])
        customers, tables = single.copy(), np.zeros(max([len(single), *[1 + int(x.max()) for r, x, _ in said if r["kind"] == CONTEXTS]]))
        for r, places, values in said:
            if r["kind"] != SINGLES:
                np.add.at(customers if r["kind"] == TABLES else tables, places, values)
        customers = customers.astype(np.int64)
        at = np.flatnonzero(customers)
        if state is None:
            seats[at] = 1
        else:
            seats[at] = draw_tables(customers[at], np.full(len(at), base), seated - seats[at].astype(float), STRENGTH, discount, np.random.default_rng([seed, 1, peer]), stirling(discount), seats[at])
        value = customers - discount * seats
        answers = [{"kind": r["kind"], "peer": peer, "bucket": r["bucket"], "values": (value if r["kind"] == TABLES else tables)[places].tobytes()} for r, places, _ in said if r["kind"] != SINGLES]
        own = {
            "kind": SEATED, "peer": peer, "customers": squeeze(single.astype(np.int64)), "seats": squeeze(seats), "more": [*more, value.astype(np.float32).tobytes()] if keep else more,
            "n_customers": int(customers.sum()), "n_seats": int(seats.sum()), "once": int((customers == 1).sum()), "twice": int((customers == 2).sum()),
        }
        return _table(SEATS, [own, *answers])

    return run


def _last_words(rows: pa.Table) -> pa.Table:
    """What the samples of the parent say of every word that a bucket asks about."""
    rows = rows.to_pylist()
    state = next(r for r in rows if r["kind"] == SEATED)
    more = [np.frombuffer(x, np.float32) for x in state["more"] or []]
    return _table(MESSAGE, [{"kind": SINGLES, "bucket": r["bucket"], "peer": r["peer"], "places": None, "values": None, "more": [x[spread(r["places"])].tobytes() for x in more]} for r in rows if r["kind"] == SINGLES])


VALUES = "chunk long, bucket int, values binary"


def _values(parts: int, discount: float, seatings: list[tuple[float, float]]):
    """The averaged probability of every pair that a chunk asked for."""

    def run(paired: pa.Table, told: pa.Table) -> pa.Table:
        row = paired.to_pylist()[0]
        counts, words, c, w, n, place, chunks, sizes = (spread(row[k]) for k in ("counts", "words", "c", "w", "n", "t", "places", "values"))
        own = _Restaurants(told.to_pylist(), parts, discount)
        own.keep()
        value = np.zeros(len(n))
        for k, (rest, total) in enumerate(seatings):
            p = (_told(own.rows, SINGLES, words, parts, lambda r, k=k: np.frombuffer(r["more"][k], np.float32)) + rest) / total
            value += np.frombuffer(own.free[k], np.float32)[c] * p[w] / len(seatings)
        tables = n.astype(float)
        tables[n > 1] = own.t_sum / len(seatings)
        value = (value + (n - discount * tables) / (STRENGTH + counts[c])).astype(np.float32)[place]
        return _table(VALUES, [{"chunk": int(x), "bucket": row["bucket"], "values": v.tobytes()} for x, v in zip(chunks, np.split(value, np.cumsum(sizes)[:-1]), strict=True)])

    return run


RESULT = "doc long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(buckets: int, total: int, types: int):
    """Scores of the documents of a chunk."""

    def run(chunk: pa.Table, told: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        place = _chunk_pairs(row, buckets)[-1]
        values = np.concatenate([np.frombuffer(x, np.float32) for x in told.sort_by("bucket").column("values").to_pylist()])
        sizes, n = spread(row["sizes"]), spread(row["seen"])[spread(row["codes"])]
        cuts = np.cumsum(sizes) - sizes
        base = np.add.reduceat(np.log10((n + 0.1) / (total + 0.1 * (types + 1))), cuts)
        score = np.add.reduceat(np.log10(values.astype(np.float64))[place], cuts)
        columns = [pa.array(row["docs"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(sizes), pa.array(np.add.reduceat((n > 0).astype(np.int64), cuts)), pa.array(base), pa.array(score)]
        return pa.Table.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    return run


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def lm_scores(docs: DataFrame, *, burn: int = 3, samples: int = 3, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    packed = kept(rows.mapInArrow(_pack, CHUNKS), "chunks")
    counted = packed.agg(F.sum(F.octet_length("words") / 8).alias("words"), F.sum((F.octet_length("codes") - 1) / F.conv(F.hex(F.substring("codes", 1, 1)), 16, 10).cast("int")).alias("tokens"),
                         F.sum(F.size(F.filter("held", lambda x: ~x))).alias("starts")).first()
    parts, buckets, starts = (int(x or 0) for x in ((counted["words"] or 0) // BUCKET + 1, (counted["tokens"] or 0) // BUCKET + 1, counted["starts"]))
    names = kept(packed.select("chunk", "held", "sizes", "words", "codes").mapInArrow(_ask_words(parts), WORDS).groupBy("bucket").applyInArrow(_number(parts), NAMES), "names")
    sums = names.agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).first()
    types, total = sums["types"] or 0, sums["tokens"] or 0
    chunks = kept(packed.groupBy("chunk").cogroup(names.groupBy("chunk")).applyInArrow(_name(starts), NUMBERED), "numbered", packed, names)
    asked = chunks.mapInArrow(_ask_pairs(buckets), PAIRS)

    both = first = kept(asked.groupBy("bucket").applyInArrow(_found(parts), BOTH), "pairs")
    message = [c.split()[0] for c in MESSAGE.split(", ")]
    singles = kept(both.filter(F.col("kind") == SINGLES).select(*message), "singles")
    few = both.filter(F.col("kind") == RESTAURANTS).agg(F.sum("once").alias("once"), F.sum("twice").alias("twice")).first()
    discount, base = discount_of(few["once"] or 0, few["twice"] or 0), 1.0 / (types + 1)
    state = lambda: both.filter(F.col("kind") == RESTAURANTS)
    said = lambda: both.filter(F.col("kind").isin(TABLES, CONTEXTS)).select(*message)
    seats = kept(said().unionByName(singles).groupBy("peer").applyInArrow(_seat(discount, base, 0, seed, False), SEATS), "seats")
    parent, seatings = 0.0, []
    for k in range(burn + samples + 1):
        own = seats.filter(F.col("kind") == SEATED)
        got = own.agg(*[F.sum(c).alias(c) for c in ("n_customers", "n_seats", "once", "twice")]).first()
        parent = parent or discount_of(got["once"] or 0, got["twice"] or 0)
        seated, customers = got["n_seats"] or 0, got["n_customers"] or 0
        # The first answers are taken by the pairs' discount, of one table a word: only a place to begin.
        rest = (STRENGTH + (parent if k else discount) * seated) * base
        if k > burn:
            seatings.append((rest, STRENGTH + customers))
        answers = seats.filter(F.col("kind") != SEATED).select("kind", "bucket", "peer", "values")
        told = state().unionByName(answers, allowMissingColumns=True)
        if k == burn + samples:
            break
        before = both if k else None
        both = kept(told.groupBy("bucket").applyInArrow(_draw(parts, discount, rest, STRENGTH + customers, seed + k, k > burn), BOTH), "state")
        if k:
            discard(before)
        before = seats
        seats = kept(said().unionByName(own.drop("bucket", "values"), allowMissingColumns=True).groupBy("peer").applyInArrow(_seat(parent, base, seated, seed + k, k >= burn), SEATS), "seats")
        discard(before)
    words = seats.filter(F.col("kind") == SEATED).select("kind", "peer", "more")
    last = kept(singles.drop("more").unionByName(words, allowMissingColumns=True).groupBy("peer").applyInArrow(_last_words, MESSAGE), "last", singles)
    told = told.unionByName(last, allowMissingColumns=True)
    paired = first.filter(F.col("kind") == PAIRED)
    values = kept(paired.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(_values(parts, discount, seatings), VALUES), "values", first, both, seats, last)
    out = chunks.groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(_score(buckets, total, types), RESULT)
    return out.select(F.col("doc").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm_score(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
