"""State that outlives a micro-batch: debounced requests by event-time timers, and a table that is merged bucket by bucket."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from auditloom.operators.joins import upsert

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Debounce(StatefulProcessor):
    """Holds the newest request of a key until ``quiet`` milliseconds of event time have passed without a newer one."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", T.StructType([T.StructField("at", T.LongType()), T.StructField("request_id", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        held = self.pending.get() if self.pending.exists() else None
        best, n = (held[0], held[1], held[2]) if held else None, held[3] if held else 0
        for frame in rows:
            for at, request, payload in zip(frame["at"], frame["request_id"], frame["payload"], strict=True):
                if best and (int(at), request) == best[:2]:
                    continue  # delivered again
                n += 1
                if best is None or (int(at), request) > best[:2]:
                    best = (int(at), request, payload)
        if best is not None:
            if held and best[0] != held[0]:
                self.handle.deleteTimer(held[0] + self.quiet)
            if not held or best[0] != held[0]:
                self.handle.registerTimer(best[0] + self.quiet)
            self.pending.update((*best, n))
        yield pd.DataFrame({"key": [], "request_id": [], "payload": [], "at": [], "n_requests": []}).astype({"key": str, "request_id": str, "payload": str, "at": "int64", "n_requests": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        if self.pending.exists():
            at, request, payload, n = self.pending.get()
            # A timer of a request that a newer one has replaced says nothing.
            if at + self.quiet <= expiredTimerInfo.getExpiryTimeInMs():
                self.pending.clear()
                yield pd.DataFrame({"key": [key[0]], "request_id": [request], "payload": [payload], "at": [at], "n_requests": [n]})

    def close(self) -> None:
        pass


def debounced(stream: DataFrame, key: str, *, ts: str = "ts", request: str = "request_id", payload: str = "payload", quiet: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """(key, request_id, payload, at, n_requests): the newest request of a key once ``quiet`` has passed without another, in append mode; n_requests counts those that it stands for.

    The newest is that of the largest (time, request id), so the order of arrival doesn't matter; a delivery of the same request again isn't counted. Requests later than ``late`` behind the newest event are dropped by the watermark. Needs the RocksDB
    state store (:data:`STORE` in ``spark.sql.streaming.stateStore.providerClass``); rows without key or time take no part.
    """
    length, unit = quiet.split()
    ms = int(float(length) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")])
    rows = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late).select(F.col(key).cast("string").alias("key"), F.unix_millis(F.col(ts).cast("timestamp")).alias("at"), F.col(request).cast("string").alias("request_id"), F.col(payload).cast("string").alias("payload"), F.col(ts))
    out = rows.groupBy("key").transformWithStateInPandas(Debounce(ms), "key string, request_id string, payload string, at long, n_requests long", "append", "EventTime")
    return out.withColumn("at", F.timestamp_millis("at"))


class BucketedTable:
    """The newest row of each key, in ``buckets`` folders by a hash of the key; a merge reads and writes only the buckets that its rows fall into.

    A manifest of each epoch names the folder of every bucket. It is written beside and renamed into place after the epoch's folders are complete, so readers see a whole epoch or the one before, and an epoch that is tried again
    either overwrites folders that nobody reads or, once its manifest is there, does nothing. Old folders stay until :meth:`vacuum`.
    """

    def __init__(self, spark: SparkSession, path: str, by: list[str], version: str, buckets: int = 64):
        self.spark, self.path, self.by, self.version, self.buckets = spark, path.rstrip("/"), by, version, buckets
        self.fs = self._place("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _epochs(self) -> list[int]:
        place = self._place("manifests")
        if not self.fs.exists(place):
            return []
        names = [str(f.getPath().getName()) for f in self.fs.listStatus(place)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, epoch: int | None = None) -> dict | None:
        """{"epoch", "buckets": {bucket: folder}} of an epoch, the last without one; None for an empty table."""
        epochs = self._epochs()
        if not epochs:
            return None
        text = self.spark.read.text(str(self._place(f"manifests/{epochs[-1] if epoch is None else epoch:012d}.json")), wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, epoch: int, folders: dict) -> None:
        waiting = self._place(f"manifests/_{epoch:012d}.tmp")
        stream = self.fs.create(waiting, True)
        stream.write(bytearray(json.dumps({"epoch": epoch, "buckets": folders}).encode()))
        stream.close()
        if not self.fs.rename(waiting, self._place(f"manifests/{epoch:012d}.json")):
            raise RuntimeError(f"epoch {epoch} of {self.path} was committed by another writer")

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def _folders(self, known: dict, wanted) -> DataFrame | None:
        places = [f"{self.path}/{known[str(b)]}" for b in wanted if str(b) in known]
        return self.spark.read.option("mergeSchema", True).parquet(*places) if places else None

    def read(self, epoch: int | None = None) -> DataFrame | None:
        """The table as of an epoch (the last without one); None while it is empty."""
        now = self.manifest(epoch)
        return self._folders(now["buckets"], now["buckets"]) if now else None

    def merge(self, batch: DataFrame, epoch: int) -> bool:
        """Merges an epoch's rows; False if that epoch is there already. Of a key's rows the highest version stays, an update before an old row of the same version."""
        now = self.manifest()
        if now and now["epoch"] >= epoch:
            return False
        known = now["buckets"] if now else {}
        rows = batch.withColumn("__bucket", self._bucket()).persist()
        try:
            # One number a bucket: as many as the table has buckets at most.
            touched = sorted(r[0] for r in rows.select("__bucket").distinct().collect())
            if touched:
                before = self._folders(known, touched)
                old = before.withColumn("__bucket", self._bucket()) if before is not None else rows.limit(0)
                merged = upsert(old, rows, self.by, self.version)
                merged.repartition(len(touched), "__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.path}/data/epoch={epoch}")
            self._commit(epoch, known | {str(b): f"data/epoch={epoch}/__bucket={b}" for b in touched})
        finally:
            rows.unpersist()
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Drops the manifests before the last ``keep`` and the folders that no manifest left names; gives their number."""
        epochs = self._epochs()
        for e in epochs[:-keep]:
            self.fs.delete(self._place(f"manifests/{e:012d}.json"), False)
        named = {folder for e in epochs[-keep:] for folder in self.manifest(e)["buckets"].values()}
        dropped = 0
        for epoch in self.fs.listStatus(self._place("data")) if self.fs.exists(self._place("data")) else []:
            for bucket in self.fs.listStatus(epoch.getPath()):
                name = f"data/{epoch.getPath().getName()}/{bucket.getPath().getName()}"
                # Folders of an epoch that isn't committed yet belong to its writer.
                if bucket.isDirectory() and name not in named and epochs and int(epoch.getPath().getName().partition("=")[2]) <= epochs[-1]:
                    self.fs.delete(bucket.getPath(), True)
                    dropped += 1
        return dropped


def bucketed_sink(table: BucketedTable) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that merges each micro-batch into a :class:`BucketedTable`."""

    def write(batch: DataFrame, epoch: int) -> None:
        table.merge(batch, epoch)

    return write
