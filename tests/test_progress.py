"""Progress of files through restarts, against a plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from lexweave.streaming.progress import DONE, STATES, Progress

SCHEMA = "path string, at bigint, kind string, error string"


def plain(events):
    out = {}
    for path, at, kind, error in sorted((e for e in events if e[0] and e[1] is not None and e[2] in STATES), key=lambda e: e[1]):
        _, attempts, text = out.get(path, (None, 0, None))
        text = (error or "")[:500] if kind == "failed" else None if STATES[kind] in DONE else text
        out[path] = (STATES[kind], attempts + (kind == "start"), text)
    return out


def test_states_survive_a_crash(spark, tmp_path):
    rng = random.Random(9)
    events = [(f"f{rng.randrange(25)}", k, rng.choice([*STATES, "other"]), f"error {k} " + "x" * 600) for k in range(400)] + [(None, 1, "start", None), ("f1", None, "start", None)]
    progress = Progress(spark, f"file://{tmp_path}/progress")
    assert progress.files().collect() == [] and progress.counters().collect() == []

    def write(rows, name):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def follow(p=progress):
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        p.follow(stream, f"{tmp_path}/checkpoint").awaitTermination()

    def check(rows):
        want = plain(rows)
        assert {r.path: (r.status, r.attempts, r.error) for r in progress.files().collect()} == want
        counts = {s: sum(x[0] == s for x in want.values()) for s in STATES.values()}
        assert {r.status: r.n for r in progress.counters().collect()} == {s: n for s, n in counts.items() if n}

    write(events[200:300], "b")  # later events come first
    write(events[:100], "a")
    follow()
    check(events[:100] + events[200:300])
    write(events[100:200], "c")
    saving = progress.saving

    def dying():
        def save(batch, number):
            saving()(batch, number)
            raise RuntimeError("killed after the commit")

        return save

    progress.saving = dying
    with pytest.raises(Exception, match="killed"):
        follow()
    progress.saving = saving
    version = progress.store.latest()
    write(events[300:], "d")
    follow()  # the batch that was committed comes again, and is passed over
    check(events)
    assert progress.store.latest() > version
    listing = spark.createDataFrame([(f"f{i}",) for i in range(40)], "path string")
    done = {p for p, x in plain(events).items() if x[0] in DONE}
    assert {r.path for r in progress.pending(listing).collect()} == {f"f{i}" for i in range(40)} - done
    assert {r.path for r in progress.failures().select("path", F.length("error").alias("n")).filter("n <= 500").collect()} == {p for p, x in plain(events).items() if x[0] == "failed"}
