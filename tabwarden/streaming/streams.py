"""Incremental forms of the batch operators on Structured Streaming.

Every function starts a query on a streaming DataFrame and returns it. By default
a query takes everything there is and ends; pass ``every`` to keep it polling.
Restarting with the same checkpoint goes on where the last run stopped.
"""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabwarden.functions.hotkeys import join_per_key
from tabwarden.functions.text import stripped_or_blank
from tabwarden.operators import comparison, submissions, validation
from tabwarden.session import own_session
from tabwarden.sources.inbox import MAX_DOCUMENT_BYTES, hash_of
from tabwarden.streaming.memory import BatchTable, KeyedTable
from tabwarden.streaming.plumbing import per_batch, to_files

#: Files of an inbox that one micro-batch takes; all that there are come in turn.
FILES_PER_BATCH = 20_000
ROW_LOCAL_CODES = ("required", "type", "min", "max", "allowed")


# --- submissions ---------------------------------------------------------------


def inbox_stream(
    spark: SparkSession, folder: str, suffix: str = ".json", max_bytes: int = MAX_DOCUMENT_BYTES
) -> DataFrame:
    """New documents in ``folder``, each file one row: ``path, doc, raw_hash, fits``.

    Files of more than ``max_bytes`` are listed without text and hash; the scan skips
    them by their length, so their bytes are never read.

    Both kinds come from one source, in batches of at most ``FILES_PER_BATCH`` files, so
    what the driver holds of a batch is bounded; of all files it keeps path and time.
    The stream has a session of its own, whose ``streams`` lists its queries: a batch
    lists its files one by one, by default in a task each, and by default a few files
    of any length fill a task that reads. The driver neither asks where files lie nor
    keeps what it listed for a batch, which is never listed again.
    """
    settings = {
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * spark.sparkContext.defaultParallelism),
        "spark.sql.sources.ignoreDataLocality": "true",
        "spark.sql.hive.filesourcePartitionFileCacheSize": "0",
        "spark.sql.files.openCostInBytes": str(MAX_DOCUMENT_BYTES),
    }
    files = (
        own_session(spark, settings)
        .readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", f"*{suffix}")
        .option("maxFilesPerTrigger", FILES_PER_BATCH)
        .option("maxCachedFiles", 10 * FILES_PER_BATCH)
        .load(folder)
    )
    size, none = F.col("_metadata.file_size"), F.lit(None).cast("string")
    small = files.filter(size <= max_bytes).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("content").cast("string").alias("doc"),
        hash_of(F.col("content")).alias("raw_hash"),
        F.lit(True).alias("fits"),
    )
    large = files.filter(size > max_bytes).select("path", none.alias("doc"), none.alias("raw_hash"), F.lit(False).alias("fits"))
    return small.unionByName(large)


def stream_inbox(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    suffix: str = ".json",
    max_bytes: int = MAX_DOCUMENT_BYTES,
) -> StreamingQuery:
    """Check every document of an inbox once, however often this is started."""
    checked = _checked_documents(inbox_stream(spark, folder, suffix, max_bytes))
    return to_files(checked, out, checkpoint, None)


def stream_poll(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    every: str = "5 seconds",
    suffix: str = ".json",
    max_bytes: int = MAX_DOCUMENT_BYTES,
) -> StreamingQuery:
    """Keep looking for new documents until stopped."""
    checked = _checked_documents(inbox_stream(spark, folder, suffix, max_bytes))
    return to_files(checked, out, checkpoint, every)


def _checked_documents(documents: DataFrame) -> DataFrame:
    checked = submissions.manifest_fields(submissions.manifest_decode(documents))
    error = F.when(F.col("fits"), F.col("error")).otherwise("too_large")
    return checked.select("path", "raw_hash", "key", "external_id", error.alias("error"))


_RECEIPT = "receipt_seq bigint, external_id string, fingerprint string"


class Dedup:
    """First receipt per content and external-id binding, across batches."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        def table(name: str, schema: str) -> BatchTable:
            return BatchTable(spark, f"{folder}/{name}", schema).create()

        self.bindings = KeyedTable(
            spark, f"{folder}/bindings", "external_id string, bound_fingerprint string", "external_id"
        ).create()
        self.events = KeyedTable(
            spark, f"{folder}/events", "fingerprint string, first_seq bigint, external_id string", "fingerprint"
        ).create()
        self.counts = table("counts", "fingerprint string, accepted bigint")
        self.conflicts = table("conflicts", _RECEIPT)

    def batch(self, receipts: DataFrame, batch_id: int) -> None:
        valid = receipts.filter(F.col("error").isNull()).select(
            "receipt_seq", "external_id", "fingerprint"
        )
        named = valid.filter(F.col("external_id").isNotNull())
        here = named.groupBy("external_id").agg(
            F.min_by("fingerprint", "receipt_seq").alias("first_fingerprint"),
            F.count(F.lit(1)).alias("uses"),
        ).persist()
        bound = here.join(self.bindings.touching(here, batch_id), "external_id", "left").select(
            "external_id",
            F.coalesce("bound_fingerprint", "first_fingerprint").alias("bound_fingerprint"),
            F.col("bound_fingerprint").isNull().alias("is_new"),
            "uses",
        ).persist()
        judged = join_per_key(valid, bound, ["external_id"], "uses", "receipt_seq").persist()
        clash = F.coalesce(F.col("fingerprint") != F.col("bound_fingerprint"), F.lit(False))
        accepted = judged.filter(~clash)
        grouped = accepted.groupBy("fingerprint").agg(
            F.min_by(F.struct("receipt_seq", "external_id"), "receipt_seq").alias("first"),
            F.count(F.lit(1)).alias("accepted"),
        ).persist()
        fresh = grouped.join(self.events.touching(grouped, batch_id), "fingerprint", "left_anti")
        self.bindings.append(bound.filter("is_new").select("external_id", "bound_fingerprint"), batch_id)
        self.events.append(
            fresh.select("fingerprint", F.col("first.receipt_seq").alias("first_seq"), "first.external_id"),
            batch_id,
        )
        self.counts.append(grouped.select("fingerprint", "accepted"), batch_id)
        self.conflicts.append(
            judged.filter(clash).select("receipt_seq", "external_id", "fingerprint"), batch_id
        )
        for used in (grouped, judged, bound, here):
            used.unpersist()

    def result(self) -> DataFrame:
        """Every event with its first receipt and number of later ones."""
        totals = self.counts.rows().groupBy("fingerprint").agg(
            (F.sum("accepted") - 1).alias("duplicates")
        )
        return self.events.rows().join(totals, "fingerprint")


def stream_dedup(
    receipts: DataFrame, state: Dedup, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Deduplicate checked receipts arriving in order of ``receipt_seq``."""
    return per_batch(receipts, state.batch, checkpoint, every)


# --- checks --------------------------------------------------------------------


def stream_validate(
    ds: DataFrame, rules: Any, out: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Row-local checks: stateless, the same expressions as in batch.

    Rules that rows alone cannot show to be broken are refused: ``unique`` (use
    ``stream_unique``) and columns that the stream does not have.
    """
    present, absent = validation.split_rules(ds, rules)
    beyond = [rule.column for rule in [*absent, *(rule for rule in present if rule.unique)]]
    if beyond:
        raise ValueError(f"rules of missing columns or unique values, in a stream: {', '.join(beyond)}")
    findings = validation.all_findings(ds, rules, ROW_LOCAL_CODES)
    return to_files(findings.select(*validation.FINDING_COLUMNS), out, checkpoint, every)


def _least_records(firsts: DataFrame) -> DataFrame:
    """The first record of each value among those known at different times."""
    return firsts.groupBy("v").agg(
        F.min("first_record").alias("first_record"), F.min_by("first_value", "first_record").alias("first_value")
    )


class Uniqueness:
    """First record of every value seen so far in one column.

    Records may come in any order. One that comes late, with a smaller number than
    the first of its value so far, takes its place; the former first is then found
    as a repeat. ``found`` names the first record as it was known when a repeat was
    found, ``result`` as it is known now.
    """

    def __init__(self, spark: SparkSession, folder: str, column: str) -> None:
        self.column = column
        self.firsts = KeyedTable(
            spark, f"{folder}/firsts", "v string, first_record bigint, first_value string", "v", _least_records
        ).create()
        self.found = BatchTable(
            spark, f"{folder}/found", "row bigint, first_record bigint, value string, v string"
        ).create()

    def batch(self, ds: DataFrame, batch_id: int) -> None:
        text = F.col(f"`{self.column}`").cast("string")
        cells = ds.select("record_no", stripped_or_blank(text).alias("v"), text.alias("value"))
        cells = cells.filter("v <> ''")
        here = cells.groupBy("v").agg(
            F.min("record_no").alias("here_first"),
            F.min_by("value", "record_no").alias("here_value"),
            F.count(F.lit(1)).alias("uses"),
        ).persist()
        known = _least_records(self.firsts.touching(here, batch_id)).toDF("v", "known_first", "known_value")
        values = here.join(known, "v", "left").persist()
        first = F.least("known_first", "here_first").alias("first_record")
        repeated = values.filter((F.col("uses") > 1) | F.col("known_first").isNotNull()).select("v", first, "uses")
        joined = join_per_key(cells, repeated, ["v"], "uses", "record_no")
        later = joined.filter(F.col("record_no") > F.col("first_record"))
        replaced = values.filter(F.col("known_first") > F.col("here_first")).select(
            F.col("known_first").alias("row"), first, F.col("known_value").alias("value"), "v"
        )
        self.firsts.append(
            values.filter(F.col("known_first").isNull() | (F.col("here_first") < F.col("known_first"))).select(
                "v", F.col("here_first").alias("first_record"), F.col("here_value").alias("first_value")
            ),
            batch_id,
        )
        self.found.append(
            later.select(F.col("record_no").alias("row"), "first_record", "value", "v").unionByName(replaced),
            batch_id,
        )
        values.unpersist()
        here.unpersist()

    def result(self) -> DataFrame:
        """Every repeat with the first record of its value: ``row, first_record, value``."""
        found = self.found.rows().drop("first_record")
        uses = found.groupBy("v").agg(F.count(F.lit(1)).alias("uses"))
        firsts = uses.join(_least_records(self.firsts.rows()), "v").select("v", "first_record", "uses")
        return join_per_key(found, firsts, ["v"], "uses", "row").select("row", "first_record", "value")


def stream_unique(
    ds: DataFrame, state: Uniqueness, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Repeated values across batches; see ``Uniqueness.result``."""
    return per_batch(ds, state.batch, checkpoint, every)


class SnapshotChain:
    """Each announced snapshot compared with the last accepted one before it.

    A snapshot whose key is missing, blank somewhere or repeated cannot be compared:
    it is recorded in ``rejected`` with the reason, and the chain goes on from the
    snapshot before it.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str) -> None:
        self.spark, self.key = spark, key
        self.accepted = BatchTable(spark, f"{folder}/accepted", "snapshot_id bigint, path string").create()
        self.rejected = BatchTable(spark, f"{folder}/rejected", "snapshot_id bigint, path string, reason string").create()
        self.summaries = BatchTable(
            spark,
            f"{folder}/diffs",
            "before_rows bigint, after_rows bigint, added bigint, removed bigint, changed bigint, unchanged bigint, "
            "total_changes bigint, reported_findings bigint, status string, snapshot_id bigint",
        ).create()
        self.diffs = self.summaries.path

    def batch(self, announced: DataFrame, batch_id: int) -> None:
        """Announcements are control rows, a few per batch."""
        last = self.accepted.rows(batch_id).orderBy(F.desc("snapshot_id")).limit(1).collect()
        kept, refused, found = [], [], None
        before = last[0] if last else None
        for after in announced.select("snapshot_id", "path").orderBy("snapshot_id").collect():
            try:
                table = self.spark.read.parquet(after.path)
                comparison.check_key_of(table, self.key)
            except (comparison.KeyContractError, AnalysisException) as error:
                refused.append((after.snapshot_id, after.path, str(error).splitlines()[0]))
                continue
            if before is not None:
                summary = comparison.compare(self.spark.read.parquet(before.path), table, self.key, checked=True).summary
                numbered = summary.withColumn("snapshot_id", F.lit(after.snapshot_id).cast("bigint"))
                found = numbered if found is None else found.unionByName(numbered)
            kept.append((after.snapshot_id, after.path))
            before = after
        if found is not None:
            self.summaries.append(found, batch_id)
        make = self.spark.createDataFrame
        self.rejected.append(make(refused, self.rejected.schema), batch_id)
        self.accepted.append(make(kept, self.accepted.schema), batch_id)


def stream_compare(
    announced: DataFrame, state: SnapshotChain, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """``announced`` brings ``(snapshot_id, path)``, any number per micro-batch."""
    return per_batch(announced, state.batch, checkpoint, every)
