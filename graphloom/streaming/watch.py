"""A watched folder as a stream of files: debounced, ingested one micro-batch at a time, with errors kept apart."""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from graphloom.functions.texts import extension
from graphloom.session import remove_folder
from graphloom.sources.documents import EXTENSIONS, parse_files


def debounce(events: DataFrame, seconds: int = 10, key: str = "path", ts: str = "ts") -> DataFrame:
    """The events that are let through: the first of a key, then each that comes `seconds` or more after the last one let through.

    A pause of `seconds` lets the next event through whatever came before, so events are cut there first; only inside such a run,
    which is short, does one event depend on those before it. Events at the same time count once.
    """
    rows = events.select(key, ts).where(F.col(key).isNotNull() & F.col(ts).isNotNull()).distinct()
    by_time = Window.partitionBy(key).orderBy(ts)
    at = micros(rows, ts)
    rows = rows.withColumn("_at", at).withColumn("_cut", (F.coalesce(F.col("_at") - F.lag("_at").over(by_time), F.lit(1 << 60)) >= seconds * 1_000_000).cast("int"))
    rows = rows.withColumn("_run", F.sum("_cut").over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    one = F.struct("_at", F.col(ts).alias("t"))
    runs = rows.groupBy(key, "_run").agg(F.array_sort(F.collect_list(one)).alias("_all"))
    start = F.filter("_all", lambda x: F.lit(False))
    passed = F.aggregate("_all", start, lambda kept, x: F.when((F.size(kept) == 0) | (x["_at"] - F.element_at(kept, F.greatest(F.size(kept), F.lit(1)))["_at"] >= seconds * 1_000_000), F.concat(kept, F.array(x))).otherwise(kept))
    return runs.select(key, F.explode(passed).alias("_x")).select(key, F.col("_x.t").alias(ts))


def micros(rows: DataFrame, ts: str):
    """Microseconds of a timestamp with or without time zone."""
    if dict(rows.dtypes)[ts] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{ts}`)")
    return F.unix_micros(F.col(ts))


def debounce_stream(events: DataFrame, seconds: int = 10, key: str = "path", ts: str = "ts") -> DataFrame:
    """The same for a stream: what is kept for a key is the time of its last event let through.

    An event that comes `seconds` or more after that is let through and takes its place; earlier ones, late ones too, lie inside the pause.
    """
    kinds = dict(events.dtypes)

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        passed = []
        for at in sorted({at for frame in frames for at in frame[ts]}):
            now = at.value // 1000
            if last is None or now - last >= seconds * 1_000_000:
                passed.append(at)
                last = now
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [name[0]] * len(passed), ts: passed})

    rows = events.select(key, ts).where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` {kinds[key]}, `{ts}` {kinds[ts]}", "last long", "append", GroupStateTimeout.NoTimeout)


FILES = "path string, time timestamp, length long"


def list_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """FILES of a folder as it is now, of the supported kinds; no content is read. Raises ValueError if it is no folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where) or not fs.getFileStatus(where).isDirectory():
        raise ValueError(f"not a folder: {folder}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.where(F.substring(extension(F.col("path")), 2, 10).isin(*EXTENSIONS)).select("path", F.col("modificationTime").alias("time"), "length")


class Watcher:
    """Feeds a folder's files to `ingest(documents)`: those there already, then each that is created, changed or moved in, whatever its time says.

    A stream of ticks lists the folder and compares it with the table of what was let through: (path, time, length, when). A file that is new or
    whose time or length is another one is read; one that changes again within `seconds` waits until they are over and is read then, as
    it is by that time, so no change is lost. The table is written anew after each batch, below `checkpoint`: a watcher that starts again goes
    on from it, and what failed half-way comes once more. A batch that fails is counted and does not end the stream.
    """

    def __init__(self, spark: SparkSession, folder: str, checkpoint: str, ingest: Callable[[DataFrame], None], seconds: float = 10, least_chars: int = 50, trigger: str = "1 second", recursive: bool = True, per_batch: int = 1000):
        list_files(spark, folder, recursive)
        self.spark, self.folder, self.recursive, self.ingest = spark, folder, recursive, ingest
        self.seconds, self.least, self.per_batch, self.states = seconds, least_chars, per_batch, f"{checkpoint.rstrip('/')}/files"
        self.lock = threading.Condition()
        self.counts = {"ingested": 0, "failed": 0, "batches": 0, "waiting": 0}
        self.scans = 0
        ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
        self.writer = ticks.writeStream.option("checkpointLocation", f"{checkpoint.rstrip('/')}/ticks").trigger(processingTime=trigger).foreachBatch(self._scan)
        self.query: StreamingQuery | None = None
        self.version = self._latest()

    def _latest(self) -> int:
        """The number of the last table that was written in full; -1 if there is none."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.states)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return max((int(n) for n in names if n.isdigit() and fs.exists(done(f"{self.states}/{n}/_SUCCESS"))), default=-1)

    def _state(self) -> DataFrame:
        schema = FILES + ", passed double"
        return self.spark.read.schema(schema).parquet(f"{self.states}/{self.version}") if self.version >= 0 else self.spark.createDataFrame([], schema)

    def _scan(self, tick: DataFrame, batch: int) -> None:
        try:
            now, old = time.time(), self._state()
            known = old.select("path", F.col("time").alias("_time"), F.col("length").alias("_length"), "passed")
            changed = list_files(self.spark, self.folder, self.recursive).join(known, "path", "left").where(~F.col("time").eqNullSafe(F.col("_time")) | ~F.col("length").eqNullSafe(F.col("_length")))
            ready = F.coalesce(F.lit(now) - F.col("passed") >= self.seconds, F.lit(True))
            found = changed.select("path", "time", "length", ready.alias("ready")).orderBy(F.desc("ready"), "time", "path").limit(self.per_batch).collect()  # per_batch rows at most
            let = [r for r in found if r["ready"]]
            if let:
                ingested, failed = self._take([r["path"] for r in let])
                fresh = self.spark.createDataFrame([(r["path"], r["time"], r["length"], now) for r in let], FILES + ", passed double")
                old.join(fresh, "path", "left_anti").select(*fresh.columns).unionByName(fresh).coalesce(1).write.parquet(f"{self.states}/{self.version + 1}")
                self.version += 1
                if self.version > 1:
                    remove_folder(self.spark, f"{self.states}/{self.version - 2}")
            with self.lock:
                self.counts["waiting"] = len(found) - len(let)
                if let:
                    self.counts["ingested"] += ingested
                    self.counts["failed"] += failed
                    self.counts["batches"] += 1
        finally:
            with self.lock:
                self.scans += 1
                self.lock.notify_all()

    def _take(self, paths: list[str]) -> tuple[int, int]:
        """(ingested, failed): a file counts as failed if it cannot be read, is gone, holds too little text, or its batch fails."""
        try:
            escaped = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]  # names are no patterns
            files = self.spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(escaped)
            documents = parse_files(files).persist()
            try:
                good = documents.where(F.col("error").isNull() & (F.length("raw_text") >= self.least))
                ok = good.count()
                if ok:
                    self.ingest(good)
                return ok, len(paths) - ok
            finally:
                documents.unpersist()
        except Exception:  # counted, and the next batch goes on
            return 0, len(paths)

    def start(self) -> Watcher:
        self.query = self.writer.start()
        return self

    def is_alive(self) -> bool:
        return self.query is not None and self.query.isActive

    def stats(self) -> dict:
        """ingested and failed: files let through so far, which add up; batches of them; waiting: files that changed within the pause."""
        with self.lock:
            return dict(self.counts)

    def drain(self, timeout: float = 300) -> None:
        """Waits until a scan that began after this call found nothing more to let through, nor anything waiting."""
        with self.lock:
            begin, taken = self.scans + 1, None
            deadline = time.time() + timeout
            while time.time() < deadline and self.is_alive():
                self.lock.wait(1)
                if self.scans > begin and not self.counts["waiting"] and taken == self.counts["batches"]:
                    return
                if self.scans >= begin:
                    taken = self.counts["batches"]
        if self.query is not None and self.query.exception():
            raise self.query.exception()

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
