"""Operator 7: near duplicates by MinHash, banding, verification and connected components.

1. Each text becomes the set of its distinct word shingles as 64-bit hashes. Texts with the same set form a class with
   the smallest id as its representative, so copies cost one row each and never form pairs.
2. A representative has 128 universal hash minima (multiply-add-shift), cut into 32 bands of 4. At a similarity of 0.8
   two sets share no band with a probability of (1 - 0.8^4)^32 = 5e-8.
3. First every member of a bucket is held against the leader it shares most bands with, and links are closed by
   connected components. Then, in buckets that still span several components, members are compared in blocks: by
   signature first, which leaves the members that may have a link to another component (at an estimate of 0.6, 5.6
   standard errors under 0.8), and those on their full sets by a product of incidence matrices. A block passes on a
   spanning forest of its links, so rows grow with members, never with pairs, though every pair is compared.
   Components of all links give the result. No cap limits a bucket.

Edge cases: a text without words, or null, has an empty set and no links; with fewer words than a shingle the whole
sequence is the only shingle; a row with a null id has no links and stays; rows with the same id are one document;
extra columns pass through, and of columns that clash with the results the operator's values stay; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyetos.llm.common import written
from hyetos.llm.components import components

HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
#: Members of a bucket whose signatures, and bytes of sets that one block holds.
BLOCK, BLOCK_BYTES = 2000, 4 << 20
_rng = np.random.default_rng(20_240_607)
_A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64)[:, None] | np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)[:, None]


class _WordHashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, size: int, seen: _WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a UTF-8 text, A-Z lower-cased."""
    words = text.lower().split() if text else ()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j]
    return np.unique(_mixed(out + np.uint64(n)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of each minimum, packed to one int64 for each band."""
    x, low = shingles >> np.uint64(32), np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), 2048):
        np.minimum(low, (_A * x[None, i : i + 2048] + _B).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint16).view(np.int64)


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    column = batch.column("text")
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _WordHashes()
        for batch in batches:
            sets = [shingle_set(t, size, seen) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                ["id", "n_shingles", "set_key", "bands"],
            )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _WordHashes()
        for batch in batches:
            sets = [shingle_set(t, size, seen).tobytes() for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"])

    return run


def _likely(percent: int):
    least = HASHES * (percent / 100 - 0.2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            same = (np.stack([np.asarray(x, np.int64) for x in batch.column("bands_u").to_pylist()]).view(np.uint16)
                    == np.stack([np.asarray(x, np.int64) for x in batch.column("bands_v").to_pylist()]).view(np.uint16)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(same >= least)) for c in (batch.column("u"), batch.column("v"))], ["u", "v"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_u"), batch.column("set_v"), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([a, b]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], ["u", "v"])

    return run


def _sides(batch: pa.RecordBatch, *fields: str) -> Iterator[tuple[int, list, list]]:
    """(bucket, left, right) of each row: the values of the members of its two blocks, or twice those of its one."""
    for row in batch.to_pylist():
        sides = []
        for block in (row["i"], row["j"]):
            part = [x for x in row["members"] if x["block"] == block]
            sides.append([[x[f] for x in part] for f in fields])
        yield row["bucket"], *sides


def _doubtful(percent: int):
    """Of two blocks of a bucket, the members that likely resemble one of another component; each pair in the first band it shares."""
    least = HASHES * (percent / 100 - 0.2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, members = [], []
            for bucket, (ids, comps, bands, band), right in _sides(batch, "id", "comp", "bands", "band"):
                if not ids or not right[0]:
                    continue
                ids2, comps2, bands2 = np.array(right[0], np.int64), np.array(right[1], np.int64), np.array(right[2], np.int64)
                ids, comps, bands = np.array(ids, np.int64), np.array(comps, np.int64), np.array(bands, np.int64)
                lanes, lanes2, at = bands.view(np.uint16), bands2.view(np.uint16), band[0]
                likely = np.empty((len(ids), len(ids2)), bool)
                for k in range(len(ids)):
                    likely[k] = (comps2 != comps[k]) & ~(bands2[:, :at] == bands[k, :at]).any(axis=1)
                    there = np.flatnonzero(likely[k])
                    likely[k, there] = (lanes2[there] == lanes[k]).sum(axis=1) >= least
                found = np.unique(np.concatenate([ids[likely.any(axis=1)], ids2[likely.any(axis=0)]]))
                buckets.append(np.full(len(found), bucket, np.int64)), members.append(found)
            if buckets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets)), pa.array(np.concatenate(members))], ["bucket", "rep"])

    return run


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets of the left with sets of the right."""
    both = left + right
    values, at, times = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    shared = np.cumsum(times > 1) - 1  # values of one set only add nothing
    use = (times > 1)[at]
    owner, at, out = owner[use], shared[at[use]], np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(shared[-1]) + 1 if len(values) else 0, 4096):
        part = (at >= lo) & (at < lo + 4096)
        cells = np.zeros((len(both), 4096), np.float32)
        cells[owner[part], at[part] - lo] = 1
        out += cells[: len(left)] @ cells[len(left) :].T
    return out


def _forest(percent: int):
    """A spanning forest of the links between two blocks' members of different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for _, left, right in _sides(batch, "id", "comp", "shingles"):
                if not left[0] or not right[0]:
                    continue
                sides = [[np.frombuffer(x, np.uint64) for x in side[2]] for side in (left, right)]
                common = common_counts(*sides)
                total = np.add.outer(*[np.array([len(s) for s in side], np.float32) for side in sides])
                labels = [np.array(side[1], np.int64) for side in (left, right)]
                linked = (100 * common >= percent * (total - common)) & (labels[0][:, None] != labels[1][None, :])
                for i in np.flatnonzero(linked.any(axis=1)):
                    for j in np.flatnonzero(linked[i]):
                        old, new = labels[1][j], labels[0][i]
                        if old != new:
                            us.append(left[0][i]), vs.append(right[0][j])
                            for side in labels:
                                side[side == old] = new
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def _block_pairs(members: DataFrame, blocks, *fields: str) -> DataFrame:
    """Rows (bucket, i, j, members) of each two blocks of a bucket, and of each alone: one shuffle, to which a member goes once for each block."""
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    return (
        members.withColumn("blocks", blocks).withColumn("block", own).withColumn("pair", F.explode(pairs))
        .groupBy("bucket", "pair.i", "pair.j").agg(F.collect_list(F.struct(F.col("rep").alias("id"), "comp", "block", *fields)).alias("members"))
    )


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with n_shingles, component_id and kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = written(texts.mapInArrow(_sign(shingle), "id long, n_shingles long, set_key binary, bands array<long>"), "signed")
    classes = written(
        signed.filter("set_key is not null and id is not null").groupBy("set_key").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"), F.max("n_shingles").alias("size")), "classes"
    )
    banded = classes.select("rep", F.posexplode("bands").alias("band", "value")).select("rep", "band", F.xxhash64("band", "value").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("leader")).filter("n > 1")
    members = written(banded.join(buckets, "bucket"), "members")
    nodes = written(members.select(F.col("rep").alias("id")).distinct(), "nodes")
    sets = written(texts.join(nodes, "id", "left_semi").mapInArrow(_sets(shingle), "id long, shingles binary").dropDuplicates(["id"]), "sets")
    signs = classes.select(F.col("rep").alias("id"), "bands")

    def links(pairs: DataFrame) -> DataFrame:
        likely = (
            pairs.join(signs.select(F.col("id").alias("u"), F.col("bands").alias("bands_u")), "u")
            .join(signs.select(F.col("id").alias("v"), F.col("bands").alias("bands_v")), "v")
            .mapInArrow(_likely(percent), "u long, v long")
        )
        return (
            likely.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("set_u")), "u")
            .join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("set_v")), "v")
            .mapInArrow(_linked(percent), "u long, v long")
        )

    votes = members.filter("rep <> leader").groupBy("rep", "leader").agg(F.count("*").alias("n"))
    best = votes.groupBy("rep").agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("leader"))
    edges = written(links(best.select(F.col("rep").alias("u"), F.col("leader").alias("v"))), "links")
    roots = components(edges)

    def placed(roots: DataFrame) -> DataFrame:
        """Each node with its component so far."""
        r = roots.select(F.col("u").alias("id"), F.col("v").alias("root"))
        return nodes.join(r, "id", "left").select("id", F.coalesce("root", "id").alias("comp"))

    inside = members.join(placed(roots).withColumnRenamed("id", "rep"), "rep").select("bucket", "band", "n", "rep", "comp")
    open_ = inside.groupBy("bucket").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 <> c2").select("bucket")
    inside = written(inside.join(open_, "bucket", "left_semi"), "open")
    signed_blocks = _block_pairs(inside.join(classes, "rep"), F.ceil(F.col("n") / BLOCK).cast("int"), "bands", "band")
    doubtful = written(signed_blocks.mapInArrow(_doubtful(percent), "bucket long, rep long").distinct(), "doubtful")
    held = doubtful.join(inside.select("bucket", "rep", "comp"), ["bucket", "rep"]).join(classes.select("rep", "size"), "rep")
    sizes = held.groupBy("bucket").agg(F.sum(8 * F.col("size")).alias("bytes"))
    held = held.join(sizes, "bucket").join(sets.withColumnRenamed("id", "rep"), "rep")
    set_blocks = _block_pairs(held, F.greatest(F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("int"), "shingles")
    edges = written(edges.unionByName(set_blocks.mapInArrow(_forest(percent), "u long, v long")), "links")
    roots = components(edges)

    by_class = classes.join(roots.select(F.col("u").alias("rep"), F.col("v").alias("root")), "rep", "left").select("set_key", F.coalesce("root", "rep").alias("root"))
    found = (
        signed.filter("id is not null").join(by_class, "set_key", "left")
        .groupBy(F.col("id").alias("__id")).agg(F.max("n_shingles").alias("n_shingles"), F.min(F.coalesce("root", "id")).alias("component_id"))
    )
    docs = docs.drop(*[c for c in ("n_shingles", "component_id", "kept") if c in docs.columns])
    joined = docs.join(found, docs[id_col].cast("long") == found["__id"], "left").drop("__id")
    return joined.withColumn("kept", F.coalesce(F.col(id_col).cast("long") == F.col("component_id"), F.lit(True)))


def op7_minhash(spark, sf_dir):
    from hyetos.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2).select("doc_id", "n_shingles", "component_id", "kept")
