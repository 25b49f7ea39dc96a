"""Leases of a delivery log, decided by event time while rows come in any order.

What is known of each attempt, its claim, beats and endings, is kept in a table in hash
buckets, of which a batch reads those of its attempts. The leases that are still open,
no more than are held at one time, are listed once per batch: those whose expiry event
time has passed are judged with the attempts that the batch brings. A row behind the
watermark is not lost: it is written to a side table, and if it changes what was told
about its attempt, a new revision is told.

State counts until event time is ``keep`` past the end of the lease. Later rows
still reach the side table, as not applied.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabwarden.functions.staging import evaluated
from tabwarden.operators.delivery import expected_delay
from tabwarden.streaming.memory import BatchTable, KeyedTable
from tabwarden.streaming.plumbing import per_batch

_CLAIM = "struct<at: bigint, id: bigint, budget: int, most: int>"
_KNOWN = f"job_id string, attempt bigint, claim {_CLAIM}, beats array<bigint>, endings array<bigint>, revision int, told struct<claim: {_CLAIM}, expiry: bigint, n_beats: bigint>, until bigint"
_KNOWN_NAMES = ["job_id", "attempt", "claim", "beats", "endings", "revision", "told", "until"]
_OUTCOME = (
    "job_id string, attempt bigint, claim bigint, expiry bigint, n_beats bigint, budget int, most int, expired boolean, revision int"
)
_LATE = "id bigint, job_id string, attempt bigint, event string, at bigint, applied boolean"


class Attempt:
    """The rule of a lease for one attempt, in microseconds, row by row. ``Leases`` decides
    all attempts of a batch so."""

    def __init__(self, known: tuple | None) -> None:
        fields = known or (None, [], [], None, None, 0, None, None, None)
        self.claim, beats, endings, self.budget, self.most, self.revision, self.told, self.told_at, self.timer = fields
        self.beats, self.endings = list(beats), list(endings)

    def add(self, event: str, at: int, budget: Any, most: Any) -> None:
        if event == "claim" and (self.claim is None or at < self.claim):
            self.claim, self.budget, self.most = at, int(budget), int(most)
        elif event == "heartbeat":
            self.beats.append(at)
        elif event in ("fail", "settle"):
            self.endings.append(at)

    def lease(self, seconds: int) -> tuple[int, int]:
        """The expiry, and the beats that count: each within the lease so far."""
        expiry, counted = self.claim + seconds * 1_000_000, 0
        for at in sorted(self.beats):
            if at < self.claim:
                continue
            if at >= expiry:
                break
            expiry, counted = at + seconds * 1_000_000, counted + 1
        return expiry, counted

    def ended(self, expiry: int) -> bool:
        return any(self.claim <= at < expiry for at in self.endings)

    def last(self) -> int:
        return max([*self.beats, *self.endings, *([] if self.claim is None else [self.claim])], default=0)

    def row(self) -> tuple:
        return (self.claim, self.beats, self.endings, self.budget, self.most, self.revision, self.told, self.told_at, self.timer)


def _lease(claim: Column, beats: Column, seconds: int) -> Column:
    """Expiry and number of beats that count, as ``Attempt.lease``."""
    span = F.lit(seconds * 1_000_000).cast("bigint")

    def state(expiry: Column, counted: Column, held: Column) -> Column:
        return F.struct(expiry.alias("expiry"), counted.alias("n_beats"), held.alias("held"))

    start = state(claim + span, F.lit(0).cast("bigint"), F.lit(True))
    return F.aggregate(
        F.array_sort(beats),
        start,
        lambda done, at: F.when(~done["held"] | (at < claim), done)
        .when(at >= done["expiry"], state(done["expiry"], done["n_beats"], F.lit(False)))
        .otherwise(state(at + span, done["n_beats"] + 1, F.lit(True))),
    )


class Leases:
    """State and results of a lease stream, batch by batch."""

    def __init__(self, spark: SparkSession, out: str, folder: str, lease_seconds: int, keep_seconds: int, late: str) -> None:
        self.spark, self.seconds, self.keep = spark, lease_seconds, keep_seconds * 1_000_000
        self.late = spark.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL '{late}')").first()[0]
        self.outcomes = BatchTable(spark, f"{out}/outcome", _OUTCOME).create()
        self.late_rows = BatchTable(spark, f"{out}/late", _LATE).create()
        self.known = KeyedTable(spark, f"{folder}/known", f"lease string, known struct<{_KNOWN}>, seen bigint", "lease").create()
        self.open = BatchTable(spark, f"{folder}/open", "lease string, wake bigint").create()
        self.clock = BatchTable(spark, f"{folder}/clock", "watermark bigint").create()

    def _newest(self, rows: DataFrame, watermark: int) -> DataFrame:
        """The last state of each attempt, if it still counts."""
        last = rows.groupBy("lease").agg(F.max_by("known", "seen").alias("known"), F.max("seen").alias("seen"))
        return last.filter(F.col("known.until") + self.keep > watermark)

    def batch(self, log: DataFrame, batch_id: int) -> None:
        """``log`` is ``(lease, job_id, attempt, id, event, at, budget, most)``."""
        before = self.clock.of(batch_id - 1).agg(F.max("watermark")).first()[0] or 0
        applied = F.coalesce(F.col("at") + self.seconds * 1_000_000 + self.keep > before, F.lit(False))
        log = log.withColumn("applied", applied).persist()
        seen = log.agg(F.max("at")).first()[0]
        # Watermarks are whole milliseconds.
        now = before if seen is None else max(before, (seen - self.late) // 1000 * 1000)
        self.late_rows.append(log.filter(F.col("at") < before).select("id", "job_id", "attempt", "event", "at", "applied"), batch_id)

        rows = log.filter(F.col("applied") & F.col("event").isin("claim", "heartbeat", "fail", "settle"))
        opened = self.open.of(batch_id - 1)
        due = opened.filter(F.col("wake") <= now).select("lease")
        states = replace(self.known, fold=lambda rows: self._newest(rows, before))
        earlier = states.touching(rows.select("lease").unionByName(due), batch_id)
        judged = self._judged(rows, due, self._newest(earlier, before), now).persist()

        told = judged.filter("changed").select(
            "job_id", "attempt", F.col("claim.at").alias("claim"), "expiry", "n_beats", "claim.budget", "claim.most", "expired", "revision"
        )
        self.outcomes.append(told, batch_id)
        known = F.struct(*_KNOWN_NAMES).alias("known")
        self.known.append(judged.select("lease", known, F.lit(batch_id).cast("bigint").alias("seen")), batch_id)
        waking = judged.filter((F.col("expiry") > now) & ~F.col("ended")).select("lease", F.col("expiry").alias("wake"))
        self.open.append(opened.filter(F.col("wake") > now).unionByName(waking).distinct(), batch_id)
        self.clock.append(self.spark.createDataFrame([(now,)], self.clock.schema), batch_id)
        judged.unpersist()
        log.unpersist()

    def _judged(self, rows: DataFrame, due: DataFrame, earlier: DataFrame, now: int) -> DataFrame:
        """The attempts of ``rows`` and ``due`` with all that is known of them. New rows,
        due leases and states meet in one shuffle."""

        def only(event: Column, value: str) -> Column:
            return F.when(event, F.col(value))

        kind, none = F.col("event"), F.lit(None)
        claim = F.struct("at", "id", "budget", "most").cast(_CLAIM)
        known = f"struct<{_KNOWN}>"
        parts = rows.select(
            "lease", "job_id", "attempt", F.lit(True).alias("touched"), F.when(kind == "claim", claim).alias("claim"),
            only(kind == "heartbeat", "at").alias("beat"), only(kind.isin("fail", "settle"), "at").alias("ending"), none.cast(known).alias("known"),
        )
        empty = [none.cast("string").alias("job_id"), none.cast("bigint").alias("attempt")]
        no_row = [none.cast(_CLAIM).alias("claim"), none.cast("bigint").alias("beat"), none.cast("bigint").alias("ending")]
        parts = parts.unionByName(due.select("lease", *empty, F.lit(True).alias("touched"), *no_row, none.cast(known).alias("known")))
        parts = parts.unionByName(earlier.select("lease", *empty, F.lit(False).alias("touched"), *no_row, "known"))
        met = parts.groupBy("lease").agg(
            F.max("touched").alias("touched"), F.max("job_id").alias("job_id"), F.max("attempt").alias("attempt"), F.min("claim").alias("claim"),
            F.collect_list("beat").alias("beats"), F.collect_list("ending").alias("endings"), F.first("known", ignorenulls=True).alias("known"),
        )

        def both(name: str) -> Column:
            return F.concat(F.coalesce(f"known.{name}", F.array().cast("array<bigint>")), name).alias(name)

        whole = evaluated(
            met.filter("touched"), "lease", F.coalesce("job_id", "known.job_id").alias("job_id"), F.coalesce("attempt", "known.attempt").alias("attempt"),
            F.least("known.claim", "claim").alias("claim"), both("beats"), both("endings"),
            F.coalesce("known.revision", F.lit(0)).alias("revision"), F.col("known.told").alias("told"),
        )
        held = evaluated(whole, *whole.columns, F.when(F.col("claim").isNotNull(), _lease(F.col("claim.at"), F.col("beats"), self.seconds)).alias("held"))
        expiry, start = F.col("held.expiry"), F.col("claim.at")
        ended = F.coalesce(F.exists("endings", lambda at: (at >= start) & (at < expiry)), F.lit(False))
        last = F.greatest(F.array_max("beats"), F.array_max("endings")) + self.seconds * 1_000_000
        found = evaluated(
            held, *whole.columns, F.col("held.n_beats").alias("n_beats"), expiry.alias("expiry"), ended.alias("ended"),
            F.coalesce((expiry <= now) & ~ended, F.lit(False)).alias("expired"), F.coalesce(expiry, last).alias("until"),
        )
        # A lease told as expired may be revoked, or get another beat within the same expiry.
        tell = F.when(F.col("expired"), F.struct("claim", "expiry", "n_beats"))
        changed = ~tell.eqNullSafe(F.col("told"))
        return found.withColumns({"changed": changed, "revision": F.col("revision") + changed.cast("int"), "told": tell})


def _time(micros: str) -> Column:
    return F.timestamp_micros(F.col(micros))


def stream_lease_timeout(
    log: DataFrame,
    lease_seconds: int,
    out: str,
    checkpoint: str,
    late: str = "10 seconds",
    keep_seconds: int = 86_400,
    every: str | None = None,
) -> StreamingQuery:
    """Attempts whose lease ran out without an ending, as soon as event time says so.

    ``log`` is ``(id, job_id, attempt, event, at_time, budget_attempts,
    max_attempts)``; the last two matter on claims. Other events than claim,
    heartbeat, fail and settle change no lease. ``out`` gets two tables, which
    ``lease_outcomes`` and ``late_rows`` read.

    An expired attempt requeues its job, without delay, or dead-letters it if the
    budget is spent. State is kept beside the checkpoint.
    """
    rows = log.select(
        F.concat_ws("/", F.col("job_id").cast("string"), F.col("attempt").cast("string")).alias("lease"),
        F.col("job_id").cast("string").alias("job_id"), F.col("attempt").cast("bigint").alias("attempt"),
        F.col("id").cast("bigint").alias("id"), "event", F.unix_micros("at_time").alias("at"),
        F.coalesce(F.col("budget_attempts").cast("int"), F.lit(0)).alias("budget"),
        F.coalesce(F.col("max_attempts").cast("int"), F.lit(0)).alias("most"),
    )
    state = Leases(log.sparkSession, out, f"{checkpoint.rstrip('/')}/leases", lease_seconds, keep_seconds, late)
    return per_batch(rows, state.batch, checkpoint, every)


def lease_outcomes(spark: Any, out: str) -> DataFrame:
    """The last word on every attempt that expired: ``job_id, attempt, started_at,
    expires_at, beats, status_after, delay_seconds, available_at, revision``. Those
    that a late row has revoked are left out."""
    last = BatchTable(spark, f"{out}/outcome", _OUTCOME).rows().groupBy("job_id", "attempt").agg(
        F.max_by(F.struct("claim", "expiry", "n_beats", "budget", "most", "expired", "revision"), "revision").alias("last")
    )
    found = last.filter("last.expired").select("job_id", "attempt", "last.*")
    dead = F.col("budget") >= F.col("most")
    delay = expected_delay(F.lit(True), F.lit(False), F.col("budget"))
    return found.select(
        "job_id", "attempt", _time("claim").alias("started_at"), _time("expiry").alias("expires_at"), F.col("n_beats").alias("beats"),
        F.when(dead, "DEAD_LETTER").otherwise("QUEUED").alias("status_after"), delay.alias("delay_seconds"),
        F.timestamp_micros(F.col("expiry") + delay * 1_000_000).alias("available_at"), "revision",
    )


def late_rows(spark: Any, out: str) -> DataFrame:
    """Rows that came behind the watermark; ``applied`` if they were still judged."""
    return BatchTable(spark, f"{out}/late", _LATE).rows().select("id", "job_id", "attempt", "event", _time("at").alias("at_time"), "applied")
