"""Progress of files through a pipeline: events folded into states as they stream in, with counters that change with them.

Each file's fold is kept by the stream; what a batch changes is committed to the shared folder as one
version, states and counters together, so that a reader, or a run that resumes, never sees half of it.
Earlier versions stay readable, as backups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexweave.sources.snapshots import Snapshots

#: States by the event that leads to them.
STATES = {"start": "processing", "extracted": "extracted", "success": "success", "duplicate": "duplicate", "failed": "failed"}
#: States that a resumed run doesn't take up again.
DONE = ("success", "duplicate")
#: Characters of an error that are kept.
ERROR = 500
PARTS = 64

_STATE = "status string, at long, attempts long, error string, failed_at long, done_at long"
_OUT = "path string, status string, attempts long, error string"


def folded(key: tuple[str], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The file's state after its events, in whatever order they come: the newest decides the status, starts are counted, an error stands until a later success."""
    status, at, attempts, error, failed_at, done_at = state.get if state.exists else (None, -1, 0, None, -1, -1)
    for events in batches:
        for when, kind, text in zip(events["at"], events["kind"], events["error"], strict=True):
            attempts += kind == "start"
            if when >= at:
                status, at = STATES[kind], int(when)
            if kind == "failed" and when >= failed_at:
                error, failed_at = (None if text is None else text[:ERROR]), int(when)
            if STATES[kind] in DONE:
                done_at = max(done_at, int(when))
    state.update((status, at, attempts, error, failed_at, done_at))
    yield pd.DataFrame({"path": [key[0]], "status": [status], "attempts": [attempts], "error": [error if failed_at > done_at else None]})


class Progress:
    def __init__(self, spark: SparkSession, root: str):
        self.store = Snapshots(spark, root)

    def follow(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        """Folds a stream of events (path, at: a number that orders them, kind, error) until it has no more. Events of other kinds, without a path or a time, are left out."""
        known = events.filter(F.col("kind").isin(*STATES) & F.col("path").isNotNull() & F.col("at").isNotNull())
        states = known.select("path", F.col("at").cast("bigint").alias("at"), "kind", "error").groupBy("path").applyInPandasWithState(folded, _OUT, _STATE, "update", "NoTimeout")
        return states.writeStream.outputMode("update").foreachBatch(self.saving()).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def saving(self) -> Callable[[DataFrame, int], None]:
        """Commits a batch's states and the counters that follow from them; a batch that comes again is passed over."""
        store = self.store

        def save(batch: DataFrame, number: int) -> None:
            if number <= store.manifest().get("batch", [{"number": -1}])[0]["number"]:
                batch.write.format("noop").mode("overwrite").save()  # the stream's own state still has to be saved
                return
            with store.change() as made:
                made.append("changed", batch.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(PARTS)).cast("int")))
                path = made.tables.pop("changed")[-1]["path"]
                new = store.spark.read.schema(f"{_OUT}, part int").parquet(path)
                touched = sorted(r.part for r in new.select("part").distinct().collect())
                old = store.parts("files", touched, made.base)
                left = new.select("status", F.lit(1).alias("n"))
                if old is not None:
                    left = left.unionAll(old.join(new, "path", "left_semi").select("status", F.lit(-1)))
                    new = old.join(new, "path", "left_anti").withColumn("part", F.pmod(F.xxhash64("path"), F.lit(PARTS)).cast("int")).unionByName(new)
                made.put("files", new.repartition("part"), "part", touched)
                if store.has("counters", made.base):
                    left = left.unionAll(store.read("counters", made.base).select("status", "n"))
                made.replace("counters", left.groupBy("status").agg(F.sum("n").alias("n")).filter("n > 0"))
                made.tables["batch"] = [{"number": number}]

        return save

    def files(self, version: int | None = None) -> DataFrame:
        """path, status, attempts, error of every file met."""
        found = self.store.parts("files", version=version)
        return self.store.spark.createDataFrame([], _OUT) if found is None else found

    def counters(self, version: int | None = None) -> DataFrame:
        """status, n."""
        return self.store.read("counters", version) if self.store.has("counters", version) else self.store.spark.createDataFrame([], "status string, n bigint")

    def pending(self, listing: DataFrame) -> DataFrame:
        """The files of a listing (path) that aren't done."""
        return listing.join(self.files().filter(F.col("status").isin(*DONE)), "path", "left_anti")

    def failures(self) -> DataFrame:
        """Path, attempts, error of the files that failed last, to be tried again."""
        return self.files().filter("status = 'failed'").select("path", "attempts", "error")
