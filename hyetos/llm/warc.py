r"""Operator 11: WARC archives, and their monolithic gzip files made readable record by record.

`write_archives` writes a record for each page as Spark's own gzip text files: one gzip stream a file, from which no
single record can be read. `normalise` inflates each such stream once, in order, rewrites every record as a gzip member
of its own, and writes a sidecar index with the offset and length of each member: as lines beside each archive
(`<archive>.idx`) and as one Parquet table of all. `read_records` reads members back by that index, each on its own.

A task holds one record at a time, so memory follows the largest record. A file is named after the attempt that wrote
it, and the Parquet index has those of attempts that Spark committed, so a lost executor or a second attempt leaves at
most a file that nothing refers to.

Of pages with equal payloads of at least `smallest` bytes the one with the smallest id is a response and the others are
revisits that refer to it. Rows with a null id come last, and rows with the same smallest id (or all with a null id) are
all responses. A null payload is empty, a null URL leaves its header out, line breaks in a URL are percent-encoded, other
columns are not read. An archive that ends within a record, or has other bytes between records than line breaks, is an
error that names the file. An empty table gives archives without records and an empty index.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyetos.llm.common import files_at, fold, remove, shared_dir, table, written

#: Between two records: the two line breaks that end one, and the beginning of the next one's version.
BETWEEN = b"\r\n\r\nWARC/1."
URN = "urn:hyetos:page:"
#: Bytes of an archive that one reading task takes, and of records in one batch.
READ_BYTES, BATCH_BYTES = 4 << 20, 4 << 20
INDEX = "file string, offset long, length long, record_id string, warc_type string, target_uri string"
RECORDS = "record_id string, warc_type string, target_uri string, refers_to string, declared_digest string, declared_bytes long, payload binary"


def _urn(id_col: Column) -> Column:
    return F.concat(F.lit(f"<{URN}"), F.url_encode(id_col.cast("string")), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_archives(
    pages: DataFrame, out: str, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", smallest: int = 100, date: str = "1970-01-01T00:00:00Z", broadcast_rows: int = 500_000,
) -> None:
    """Write the pages as WARC records into monolithic gzip files in the folder `out`, a file for each task.

    Payloads with copies are joined by digest: broadcast up to `broadcast_rows` digests, shuffled beyond.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"))
    copies = rows.filter(F.octet_length("body") >= smallest).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")
    copies = written(copies, "payloads")
    if copies.count() <= broadcast_rows:
        copies = F.broadcast(copies)
    rows = rows.join(copies, "digest", "left").withColumn("revisit", F.coalesce(~F.col("id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat("http", F.when(F.col("revisit"), F.lit("")).otherwise(F.col("body")))
    profile = F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\n"),
        _header("WARC-Record-ID", F.coalesce(_urn(F.col("id")), F.lit("<urn:hyetos:no-id>"))),
        _header("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        _header("WARC-Date", F.lit(date)), _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        _header("WARC-Profile", profile), _header("WARC-Refers-To", F.when(F.col("revisit"), _urn(F.col("first")))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n"),
    )
    # The writer ends each row with a line break: the second of the two that end a record.
    record = rows.withColumn("http", http).withColumn("block", block).select(F.concat(head, "block", F.lit("\r\n")).alias("value"))
    record.write.option("compression", "gzip").option("lineSep", "\r\n").text(out)


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; the version line is left out, a folded line belongs to the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += f" {line.strip()}"
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


class _Splitter:
    """Whole records from the pieces of a file between occurrences of BETWEEN, which payloads may hold too."""

    def __init__(self, source: str):
        self.source, self.held, self.need, self.fields, self.done = source, None, None, {}, 0

    def put(self, piece: bytes) -> tuple[dict[str, str], bytes] | None:
        """Headers and bytes of a record, if this piece completes one."""
        if self.held is None:
            if not self.done and not piece.startswith(b"WARC/1."):
                raise ValueError(f"{self.source} doesn't begin with a WARC record")
            self.held, self.need = bytearray(piece if not self.done else BETWEEN[4:] + piece), None
        else:
            self.held += BETWEEN + piece
        if self.need is None and (end := self.held.find(b"\r\n\r\n")) >= 0:
            self.fields = _fields(bytes(self.held[:end]))
            self.need = end + 4 + int(self.fields["content-length"])
        if self.need is None or len(self.held) < self.need:
            return None
        if self.held[self.need :].strip(b"\r\n"):
            raise ValueError(f"{self.source}: record {self.done} is longer than it says")
        record, self.held, self.done = bytes(self.held[: self.need]), None, self.done + 1
        return self.fields, record

    def end(self) -> None:
        if self.held is not None:
            raise ValueError(f"{self.source} ends within record {self.done}")


class _Archive:
    """An archive being written, with its sidecar."""

    def __init__(self, name: str):
        files, path = files_at(name)
        self.name, self.size, self.lines = name, 0, []
        self.out, self.side = files.open_output_stream(path, compression=None), lambda: files.open_output_stream(f"{path}.idx")

    def put(self, member: bytes, record_id: str) -> tuple[int, int]:
        at = self.size, len(member)
        self.out.write(member)
        self.size += len(member)
        self.lines.append(f"{at[0]}\t{at[1]}\t{record_id}\n")
        return at

    def close(self) -> None:
        self.out.close()
        with self.side() as side:
            side.write("".join(self.lines).encode())


def _rewrite(out: str, level: int, archive_bytes: int):
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, splitter, archive, n, rows = TaskContext.get().taskAttemptId(), None, None, 0, []
        for batch in batches:
            for piece, source in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if splitter is None or source != splitter.source:
                    if splitter:
                        splitter.end()
                        archive = archive and archive.close()
                    splitter = _Splitter(source)
                if not (found := splitter.put(piece.as_py())):
                    continue
                fields, record = found
                if archive and archive.size >= archive_bytes:
                    archive = archive.close()
                if not archive:
                    archive, n = _Archive(f"{out}/{attempt}-{n:05d}.warc.gz"), n + 1
                name = fields.get("warc-record-id", "")
                rows.append((archive.name, *archive.put(zlib.compress(record + b"\r\n\r\n", level, 31), name), name, fields.get("warc-type"), fields.get("warc-target-uri")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows = []
        if splitter:
            splitter.end()
        if archive:
            archive.close()

    return run


def normalise(spark: SparkSession, source: str, out: str, *, level: int = 6, archive_bytes: int = 1 << 30) -> DataFrame:
    """Rewrite the gzip WARC files at `source` with a member for each record into the folder `out`; the index table.

    The index has a row for each record: file, offset, length, record_id, warc_type, target_uri. It stays at `out`/index.
    """
    files, path = files_at(out)
    files.create_dir(path, recursive=True)
    pieces = spark.read.option("lineSep", BETWEEN.decode()).text(source).select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("source"))
    pieces.mapInArrow(_rewrite(out, level, archive_bytes), INDEX).write.parquet(f"{out}/index")
    return spark.read.schema(INDEX).parquet(f"{out}/index")


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]
    rows, held, current, stream = [], 0, None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if file != current:
                if stream:
                    stream.close()
                files, path = files_at(file)
                current, stream = file, files.open_input_file(path)
            one = zlib.decompressobj(31)
            data = one.decompress(stream.read_at(length, offset))
            if not one.eof or one.unused_data:
                raise ValueError(f"{file}: no single gzip member of {length} bytes at {offset}")
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = _fields(head)
            block = rest[: int(fields["content-length"])]
            is_http = fields.get("content-type", "").startswith("application/http")
            http, _, payload = block.partition(b"\r\n\r\n") if is_http else (b"", b"", block)
            declared = _fields(http).get("content-length", "")
            rows.append((fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), fields.get("warc-payload-digest"), int(declared) if declared.isdigit() else None, payload))
            held += len(payload)
            if held >= BATCH_BYTES or len(rows) >= 1000:
                yield out()
                rows, held = [], 0
    if rows:
        yield out()


def read_records(index: DataFrame) -> DataFrame:
    """The records of an index of `normalise`, each inflated on its own from its place: headers and payload (the HTTP body)."""
    size = index.agg(F.sum("length")).first()[0] or 0
    parts = max(index.sparkSession.sparkContext.defaultParallelism, -(-size // (128 << 20)))
    places = index.select("file", "offset", "length").repartition(parts, "file", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("file", "offset")
    return places.mapInArrow(_fetch, RECORDS)


def page_of(urn: Column) -> Column:
    """The page id, as text, in a record id of `write_archives`; null if there is none."""
    inner = F.regexp_extract(urn, f"^<{URN}(.*)>$", 1)
    return F.when(F.contains(urn, F.lit(URN)), F.url_decode(inner))


def op11_warc_normaliser(spark, sf_dir):
    base = f"{shared_dir(spark)}/{fold('warc')}"
    write_archives(table(spark, sf_dir, "pages"), f"{base}/monolithic")
    index = normalise(spark, f"{base}/monolithic", f"{base}/archives")
    remove(spark, f"{base}/monolithic")
    revisit = F.col("warc_type") == "revisit"
    return read_records(index).select(
        page_of(F.col("record_id")).cast("long").alias("page_id"),
        F.when(revisit, F.col("declared_bytes")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.replace("declared_digest", F.lit("sha256:"), F.lit(""))).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), page_of(F.col("refers_to")).cast("long").alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN first END AS refers_to
FROM (SELECT *, coalesce(payload_bytes >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL, false) AS revisit FROM q)
"""
