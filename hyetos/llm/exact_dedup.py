"""Operator 8: exact duplicates by a stateful stream.

The documents table is read as a stream. Its state, kept in RocksDB on disk and checkpointed to the shared folder,
has one entry for each digest and never expires: the number of rows seen, and of the best row its length, stable
identifier and content locator (file and row in it). Each micro-batch is pre-aggregated before its shuffle, so a
group that holds a third of all rows sends one row per task. When the stream has consumed the table, every row whose
digest has more than one row is a hit: its full normalised bytes are compared with those at the locator, the row that
stays. Rows that only share the digest are grouped by their bytes instead. Up to `broadcast_rows` digests of groups are
broadcast to the rows; beyond, rows meet them in a shuffle.

Texts are equal when they are identical without ASCII white space. Of equal texts the row with the most code points
stays, then the smallest id; a null text counts as empty, a null id comes last. Ids are read as 64-bit integers, also from
text. The path may be a pattern, as for Spark's readers. Of rows with the same id, length and
text one stays, the one at the locator. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyetos.llm.common import shared_dir, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of one digest that one task compares.
SALT_ROWS = 20_000


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for space in " \t\n\x0b\f\r":
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def _better(id_col: Column, text: Column) -> Column:
    """Orders rows: longer first, then the smaller id; the largest value stays."""
    return F.struct(F.length(F.coalesce(text, F.lit(""))).alias("len"), F.bitwise_not(id_col).alias("inv"))


def digest_state(spark: SparkSession, path: str, schema, *, id_col: str, text_col: str, files_per_trigger: int) -> DataFrame:
    """Run the stream over all files now at `path`; the last state of every digest."""
    own, base = spark, f"{shared_dir(spark)}/exact-{uuid.uuid4().hex}"
    conf = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        # One store for each partition: many small stores shall not reserve disk ahead, nor upload whole snapshots each time.
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    # Only a pattern may name a single file of a stream.
    path = path.rstrip("/")
    pattern = path if re.search(r"[][{}*?\\]", path) else f"{path[:-1]}[{path[-1]}]"
    # A session of its own, so that other queries keep their options.
    spark = spark.newSession()
    for k, v in conf.items():
        spark.conf.set(k, v)
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)
        .select(
            F.sha2(normalised(F.col(text_col)), 256).alias("digest"),
            _better(F.col(id_col).cast("long"), F.col(text_col)).alias("best"),
            F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("locator"),
        )
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.max(F.struct("best", "locator")).alias("top"))
        .select("digest", "n", F.col("top.best.len").alias("len"), F.bitwise_not("top.best.inv").alias("keep_id"), F.col("top.locator").alias("locator"))
    )
    out = f"{base}/updates"

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(put)
        .option("checkpointLocation", f"{base}/stream").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    updates = own.read.schema("digest string, n long, len int, keep_id long, locator struct<file_path:string,row_index:long>, epoch long").parquet(f"{out}/epoch=*")
    return updates.groupBy("digest").agg(F.max_by(F.struct("n", "keep_id", "locator"), "epoch").alias("s")).select("digest", "s.*")


def exact_dedup(
    spark: SparkSession, path: str, *, id_col: str = "doc_id", text_col: str = "text", files_per_trigger: int = 1000, broadcast_rows: int = 500_000,
) -> DataFrame:
    """One row for each row of the Parquet table at `path`: id, keep_id, group_size, kept, text_sha256."""
    stored = spark.read.parquet(path)
    docs = stored.select(F.col(id_col).cast("long").alias(id_col), text_col, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    if docs.isEmpty():
        return docs.select(F.col(id_col), F.lit(0).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lit("").alias("text_sha256"))
    schema = stored.select(id_col, text_col).schema
    state = written(digest_state(spark, path, schema, id_col=id_col, text_col=text_col, files_per_trigger=files_per_trigger), "digests")
    alone = state.filter("n = 1").select(F.col("keep_id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"))

    groups = state.filter("n > 1").select("digest", "n", "keep_id", F.col("locator.file_path").alias("keep_file"), F.col("locator.row_index").alias("keep_row"))
    if groups.count() <= broadcast_rows:
        groups = F.broadcast(groups)
    members = written(
        docs.select(id_col, "file", "row", F.length(F.coalesce(text_col, F.lit(""))).alias("len"), normalised(F.col(text_col)).alias("body"))
        .withColumn("digest", F.sha2("body", 256)).join(groups, "digest")
        .withColumn("stays", (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))).drop("keep_file", "keep_row"),
        "members",
    )
    # What is at the locator, once for each part of its group.
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    stays = members.filter("stays").select("digest", F.col("body").alias("keep_body"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    hits = members.withColumn("salt", F.pmod(F.xxhash64("file", "row"), salts).cast("int"))
    compared = hits.join(stays, ["digest", "salt"], "left").withColumn("same", F.coalesce(F.col("body") == F.col("keep_body"), F.lit(False)))
    compared = written(compared.select(id_col, "file", "row", "stays", "keep_id", "n", "digest", "len", "same", F.when(~F.col("same"), F.col("body")).alias("other")), "compared")
    same = compared.groupBy("digest").agg(F.count(F.when(F.col("same"), 1)).alias("n_same"), F.count(F.when(~F.col("same"), 1)).alias("n_other"))
    clashes = written(same.filter("n_other > 0").select("digest", "n_same"), "clashes")
    if clashes.count() <= broadcast_rows:
        clashes = F.broadcast(clashes)
    matched = compared.filter("same").join(clashes, "digest", "left").select(
        id_col, "keep_id", F.coalesce("n_same", "n").alias("group_size"), F.col("stays").alias("kept"), F.col("digest").alias("text_sha256"))
    # Rows that share a digest but not the bytes: grouped by the bytes.
    at = F.struct("len", F.bitwise_not(id_col).alias("inv"), "file", "row")
    odd = compared.filter("not same")
    odd_groups = odd.groupBy("digest", "other").agg(F.count("*").alias("group_size"), F.max(at).alias("best"))
    others = odd.join(odd_groups, ["digest", "other"]).select(
        id_col, F.bitwise_not("best.inv").alias("keep_id"), "group_size", ((F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))).alias("kept"), F.col("digest").alias("text_sha256"))
    return alone.unionByName(matched).unionByName(others)


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
), g AS (
  SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY len DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")
