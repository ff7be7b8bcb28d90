"""The feed, lifecycles and rates as streams.

Each function takes a streaming DataFrame (most take a batch one too); sinks and
checkpoints are the caller's.  What a stream has to know of earlier rows is state of the key,
so a batch reads its own rows and the state of their keys, however long the stream has run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.documents import TRANSITIONS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drop_repeats(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Exact repeats within the watermark on fetched_at go; a cheap filter before the
    table of records is asked."""
    return events.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["source_id", "external_id", "payload_hash"])


_CHANGES = ("STAGED", "REJECTED", "NEEDS_REVIEW", "SETTLED")


class _Records(StatefulProcessor):
    """State: the record as it stands, and how often it was changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stands = handle.getValueState("stands", "payload_hash string, status string, fetched_at timestamp, version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        if not frames:
            return
        batch = pd.concat(frames)
        stands = self.stands.get() if self.stands.exists() else (None, None, None, 0)
        out = []
        # What became of records that came before, then the newest that came now.
        for status in batch.loc[batch["settled"].notna()].sort_values("fetched_at")["settled"]:
            if stands[0] is not None:
                stands = (stands[0], status, stands[2], stands[3] + 1)
                out.append(("SETTLED", *stands))
        fed = batch.loc[batch["settled"].isna()].sort_values(["fetched_at", "payload_hash"], ascending=[False, True])
        if len(fed):
            new = fed.iloc[0]
            verdict = self.verdict(stands, new)
            if verdict in _CHANGES:
                status = ("NORMALIZED" if pd.isna(new["resolved"]) else new["resolved"]) if verdict == "STAGED" else verdict
                stands = (new["payload_hash"], status, new["fetched_at"], stands[3] + 1)
            out.append((verdict, *stands))
        if out:
            self.stands.update(tuple(stands))
            yield pd.DataFrame([(*key, *o) for o in out], columns=["source_id", "external_id", "verdict", "payload_hash", "status", "fetched_at", "version"])

    @staticmethod
    def verdict(stands: tuple, new: pd.Series) -> str:
        """The rules of ``ingest_verdicts`` for one record."""
        known, status, at, _ = stands
        if known is not None:
            if pd.Timestamp(at) > new["fetched_at"]:
                return "LATE"
            if known == new["payload_hash"] and status != "FAILED":
                return "DUPLICATE"
            if status == "PUBLISHED":
                return "NEEDS_REVIEW" if pd.isna(new["error"]) else "UNCHANGED"
        return "STAGED" if pd.isna(new["error"]) else "REJECTED"

    def close(self) -> None:
        pass


def ingest(events: DataFrame) -> DataFrame:
    """Idempotent ingest: the newest record per key of each micro-batch, its verdict, and how
    the record stands after it, as a stream of changes.

    events: source_id, external_id, fetched_at, payload_hash, error, resolved, and settled: null
    for what the feed brings, else the status that work has given the record (PUBLISHED,
    FAILED ..).  Result: source_id, external_id, verdict, payload_hash, status, fetched_at,
    version (changes so far).  Needs the RocksDB state store; a batch that comes again
    after a failure begins at the state before it, so its changes are the same.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    ddl = f"source_id {kinds['source_id']}, external_id {kinds['external_id']}, verdict string, payload_hash string, status string, fetched_at timestamp, version long"
    return events.groupBy("source_id", "external_id").transformWithStateInPandas(_Records(), outputStructType=ddl, outputMode="Append", timeMode="None")


def record_table(changes: DataFrame) -> DataFrame:
    """The records as they stand, from the changes so far (a batch DataFrame)."""
    last = F.max_by(F.struct("payload_hash", "status", "fetched_at", "version"), "version").alias("r")
    return changes.where(F.col("verdict").isin(*_CHANGES)).groupBy("source_id", "external_id").agg(last).select("source_id", "external_id", "r.*")


class _Claims(StatefulProcessor):
    """State: attempts so far, the claim that holds the job (its id and time), and whether the
    job is finished.  A timer ends a claim that nothing else ends."""

    def __init__(self, stale: pd.Timedelta, most: int):
        self.stale, self.most = stale, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "attempts int, claim long, at timestamp, finished boolean")

    def _rows(self, key, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(*key, *r) for r in rows], columns=["job_id", "id", "verdict", "at", "attempts"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        if not frames:
            return
        attempts, claim, at, finished = self.job.get() if self.job.exists() else (0, None, None, False)
        had = at
        out = []
        for event in pd.concat(frames).sort_values(["at", "id"]).itertuples():
            now = event.at
            if at is not None and now > pd.Timestamp(at) + self.stale:
                out.append((claim, "EXPIRED", pd.Timestamp(at) + self.stale, attempts))
                claim = at = None
            if event.kind == "claim":
                if finished:
                    verdict = "FINISHED"
                elif at is not None:
                    verdict = "HELD"
                elif attempts >= self.most:
                    verdict = "EXHAUSTED"
                else:
                    verdict, attempts, claim, at = "GRANTED", attempts + 1, int(event.id), now
            elif at is None:
                verdict = "STALE"
            else:
                verdict, finished = ("DONE", True) if event.kind == "done" else ("FAILED", False)
                claim = at = None
            out.append((int(event.id), verdict, now, attempts))
        for old in {had, at}:
            if old is not None:
                when = int((pd.Timestamp(old) + self.stale).timestamp() * 1000)
                self.handle.registerTimer(when) if old == at else self.handle.deleteTimer(when)
        self.job.update((attempts, claim, at, finished))
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempts, claim, at, finished = self.job.get()
        if at is not None and int((pd.Timestamp(at) + self.stale).timestamp() * 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            self.job.update((attempts, None, None, finished))
            yield from self._rows(key, [(claim, "EXPIRED", pd.Timestamp(at) + self.stale, attempts)])

    def close(self) -> None:
        pass


def claims(events: DataFrame, stale: str = "15 minutes", most: int = 3, delay: str = "1 minute") -> DataFrame:
    """What becomes of claims on jobs: a claim holds its job until it is done, fails, or is
    older than ``stale``; a job is claimed ``most`` times at most.

    events: id, job_id, kind (claim, done, fail), at, in order across micro-batches.  Result:
    job_id, id, verdict, at, attempts: GRANTED, HELD (another claim stands), EXHAUSTED or
    FINISHED for a claim; DONE, FAILED, or STALE where no claim stands, for an end; and
    EXPIRED for a claim at the time it ends by itself, which is told when the watermark has
    passed it or the job's next event comes.  Needs the RocksDB state store.
    """
    job = events.schema["job_id"].dataType.simpleString()
    schema = f"job_id {job}, id long, verdict string, at timestamp, attempts int"
    return events.withWatermark("at", delay).groupBy("job_id").transformWithStateInPandas(_Claims(pd.Timedelta(stale), most), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def request_rates(runs: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Reserved requests per source in sliding minutes, for a monitor; late runs are
    dropped here only, the exact check reads the history."""
    w = F.window("created_at", "60 seconds", "10 seconds")
    return runs.withWatermark("created_at", delay).groupBy("source_id", w).agg(F.sum("reserved").alias("reserved")).select("source_id", F.col("window.end").alias("until"), "reserved")


def daily_usage(runs: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Requested records per source and UTC day."""
    w = F.window("created_at", "1 day")
    return runs.withWatermark("created_at", delay).groupBy("source_id", w).agg(F.sum("requested").alias("requested")).select("source_id", F.col("window.start").alias("day"), "requested")


class _Lifecycle(StatefulProcessor):
    """State: the last status of a record."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        if not frames:
            return
        kind, entity = key
        events = pd.concat(frames).sort_values(["at", "id"])
        status = events["status"].reset_index(drop=True)
        previous = status.shift().astype(object)
        previous.iloc[0] = self.last.get()[0] if self.last.exists() else None
        step = previous + ">" + status
        known = {f"{a}>{b}" for a, after in TRANSITIONS.get(kind, {}).items() for b in after}
        allowed = previous.isna() | (previous == status) | step.isin(known)
        self.last.update((status.iloc[-1],))
        yield pd.DataFrame({"id": events["id"].to_numpy(), "kind": kind, "entity_id": entity, "status": status, "previous": previous, "allowed": allowed})

    def close(self) -> None:
        pass


def audit_lifecycle(events: DataFrame) -> DataFrame:
    """Each status change of (kind, entity_id) against the rules, by keyed state; events:
    id, kind, entity_id, status, at, in order across micro-batches. Needs the
    RocksDB state store."""
    schema = "id long, kind string, entity_id long, status string, previous string, allowed boolean"
    return events.groupBy("kind", "entity_id").transformWithStateInPandas(_Lifecycle(), outputStructType=schema, outputMode="Append", timeMode="None")


def current_results(results: DataFrame, work: DataFrame) -> DataFrame:
    """results joined to work by (doc_id, signature, token): verdict CURRENT or STALE."""
    now = work.select("doc_id", "signature", "token", F.lit(True).alias("__now"))
    j = results.join(now, ["doc_id", "signature", "token"], "left")
    return j.withColumn("verdict", F.when(F.col("__now"), "CURRENT").otherwise("STALE")).drop("__now")
