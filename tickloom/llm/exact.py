"""Exact deduplication over a stateful stream (operator 3).

1. Every row's digest, stable identifier and content locator (file and row) land
   in an arrival log in the shared folder.  The texts stay where they are.
2. A streaming query reads the log and keeps, in RocksDB state keyed by digest
   and without expiry, the first identifier, its locator and the number of
   rows.  Copies are pre-aggregated before the shuffle, so a text that a third
   of all rows carry is one state row and a few partial rows.  A micro-batch
   gives on the states that it changed; the state itself is written once.
3. A row whose digest is held by another locator is a *hit*.  Hits are checked
   on full bytes against the text at the kept locator.  Only texts with copies
   are read for it, and the kept text of a group of n rows is dealt to
   ceil(n / ``SALT_ROWS``) salts, so no task gets a whole group.  Rows that
   differ in spite of an equal digest are grouped again by their full text.

State and progress live below ``state_dir``: a later run reads on from there, and
a lost executor only repeats its share of a micro-batch.  A row of an earlier run
stays before any row of a later one (it has been kept already); within a run the
smallest doc_id stays.  Locators name Parquet files, which must stay in place.

Rows: null text counts as empty; null doc_ids sort after all others; of rows
with equal text and doc_id (repeated rows) the one with the smallest locator
stays.  Empty tables give no rows.  Extra columns pass by.
"""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, at_places, documents, filesystem, released, store, without_places, write_sides

#: Rows of a group that share one copy of the kept text during the check.
SALT_ROWS = 500
#: Arrival-log files that one micro-batch takes.
FILES_PER_BATCH = 4096
LOCATOR = "struct<file: string, row: bigint>"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def plain(docs: DataFrame) -> DataFrame:
    """``docs`` itself if its rows have places in files, else its rows landed once."""
    try:
        docs.select(F.col("_metadata.row_index"))
    except AnalysisException:
        return store(docs, "landed")
    return docs


def with_places(docs: DataFrame) -> DataFrame:
    """``place`` and ``whole`` (a struct of all columns) of every row: no names can clash."""
    return located(docs.select(F.struct("*").alias("whole"))).withColumnRenamed("locator", "place")


def located(docs: DataFrame) -> DataFrame:
    """Rows with a ``locator`` (file, row): where their content can be read.

    Callers select the columns they need first, none of them named locator.
    """
    here = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return plain(docs).select("*", here.alias("locator"))


def group_states(log: str, schema: str, spark: SparkSession, state_dir: str, scratch: Scratch) -> DataFrame:
    """Feed what is new in the arrival log through the keyed state; the state of each digest that arrived."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(log)
    order = F.struct("run", F.col("doc_id").isNull().alias("absent"), "doc_id", "locator")
    held = rows.groupBy("digest").agg(F.min(order).alias("keep"), F.count(F.lit(1)).alias("n"))
    state = "spark.sql.streaming.stateStore."
    settings = {
        f"{state}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        f"{state}rocksdb.changelogCheckpointing.enabled": "true",
        # A store of a partition is closed after its batch: its files are as large as a manifest at least.
        f"{state}unloadOnCommit": "true",
        f"{state}rocksdb.boundedMemoryUsage": "true",
        f"{state}rocksdb.maxMemoryUsageMB": "200",
    }
    out = scratch.folder("groups")
    with released(spark, **settings):
        # Update output: a batch gives on the states that it changed, and no others.
        query = (
            held.writeStream.outputMode("update")
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
            .option("checkpointLocation", f"{state_dir}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    shape = f"digest string, keep struct<run: int, absent: boolean, doc_id: bigint, locator: {LOCATOR}>, n bigint"
    batches = sorted({p["batchId"] for p in query.recentProgress if p["numInputRows"]})
    if not batches:
        return spark.createDataFrame([], shape)
    changed = spark.read.schema(f"{shape}, batch long").option("basePath", out).parquet(out)
    if len(batches) == 1:
        return changed.drop("batch")
    return changed.groupBy("digest").agg(F.max(F.struct("batch", "keep", "n")).alias("last")).select("digest", "last.keep", "last.n")


def _next_run(spark: SparkSession, log: str) -> int:
    fs, base = filesystem(log)
    if fs.get_file_info(base).type == pafs.FileType.NotFound:
        return 0
    last = spark.read.schema("run int").parquet(log).agg(F.max("run")).first()[0]
    return 0 if last is None else last + 1


def assign(docs: DataFrame, text: Column | None = None, digest=sha256, state_dir: str | None = None) -> DataFrame:
    """Each row's ``locator``, ``digest``, ``doc_id``, ``keep_id``, ``group_size``, ``kept``.

    ``text``: what must be equal (default: the normalised text).  ``digest``:
    from that text to the state's key.  ``state_dir``: state of earlier runs; the
    answer is about the rows of ``docs`` alone, held against all runs so far.
    """
    spark = docs.sparkSession
    docs = located(docs.select("doc_id", "text"))
    text = normalised(F.col("text")) if text is None else text
    with Scratch(spark) as scratch:
        state_dir = state_dir or scratch.folder("dedup-state")
        return store(_assigned(docs, text, digest, state_dir, scratch), "dedup")


def _assigned(docs: DataFrame, text: Column, digest, state_dir: str, scratch: Scratch) -> DataFrame:
    spark, log = docs.sparkSession, f"{state_dir}/arrivals"
    run = _next_run(spark, log)
    ids = F.col("doc_id").cast("long").alias("doc_id")
    docs.select(F.lit(run).cast("int").alias("run"), ids, digest(text).alias("digest"), "locator").write.mode("append").parquet(log)
    schema = f"run int, doc_id bigint, digest string, locator {LOCATOR}"
    groups = group_states(log, schema, spark, state_dir, scratch)
    arrivals = spark.read.schema(schema).parquet(log).where(F.col("run") == run)
    rows = arrivals.drop("run").join(groups, "digest")
    alone = rows.where("n = 1").select("locator", "digest", "doc_id", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.lit(True).alias("kept"))
    many = groups.where("n > 1")
    if many.isEmpty():
        return alone
    # Texts of the rows with copies, and of what they are held against.
    sides = scratch.folder("copies")
    write_sides(rows.where("n > 1").select("locator.file", "locator.row", F.lit(1).cast("long").alias("value")), sides)
    texts = at_places(docs.select(ids, "text", "locator"), sides, "value").select("locator", "doc_id", text.alias("own"))
    texts = scratch.store(texts.withColumn("digest", digest(F.col("own"))), "copied-texts")
    held = texts.join(many.select("digest", F.col("keep.locator").alias("locator")), ["digest", "locator"]).select("digest", F.col("own").alias("held"))
    if run:
        old = scratch.store(many.where(F.col("keep.run") < run).select("digest", "keep.locator"), "earlier")
        files = [r["file"] for r in old.select("locator.file").distinct().collect()]  # names of input files
        if files:
            earlier = scratch.folder("earlier-copies")
            write_sides(old.select("locator.file", "locator.row", F.lit(1).cast("long").alias("value")), earlier)
            there = at_places(located(spark.read.parquet(*files).select("text")), earlier, "value").select(text.alias("held"))
            held = held.unionByName(there.select(digest(F.col("held")).alias("digest"), "held"))
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    spread = many.select("digest", "keep", "n", salts.alias("salts")).join(held, "digest")
    spread = spread.select("digest", "keep", "n", "held", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    hits = texts.join(many.select("digest", salts.alias("salts")), "digest")
    hits = hits.withColumn("salt", F.pmod(F.xxhash64("locator"), F.col("salts")).cast("int")).drop("salts")
    same = F.col("own") == F.col("held")
    checked = hits.join(spread, ["digest", "salt"]).select("locator", "digest", "doc_id", "keep", "n", same.alias("same"), F.when(~same, F.col("own")).alias("own"))
    checked = scratch.store(checked, "checked")
    bad = checked.where("not same")
    if bad.isEmpty():
        return alone.unionByName(_held(checked, F.col("n"), "keep"))
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "locator")
    again = bad.groupBy("digest", "own").agg(F.min(order).alias("keep2"), F.count(F.lit(1)).alias("n2"))
    wrong = bad.groupBy("digest").agg(F.count(F.lit(1)).alias("wrong"))
    same = _held(checked.where("same").join(wrong, "digest", "left"), F.col("n") - F.coalesce("wrong", F.lit(0)), "keep")
    return alone.unionByName(same).unionByName(_held(bad.join(again, ["digest", "own"]), F.col("n2"), "keep2"))


def _held(rows: DataFrame, size: Column, keep: str) -> DataFrame:
    kept = (F.col("locator") == F.col(f"{keep}.locator")).alias("kept")
    return rows.select("locator", "digest", "doc_id", F.col(f"{keep}.doc_id").alias("keep_id"), size.alias("group_size"), kept)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns."""
    docs = plain(docs)
    return without_places(docs, assign(docs).where("not kept").select("locator.file", "locator.row"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""
