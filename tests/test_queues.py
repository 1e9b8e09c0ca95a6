"""Bounded queues and batches: tables against plain loops, streams against tables."""

import random

import pytest
from pyspark.sql import functions as F

from postloom.streaming import queues

RNG = random.Random(9)


@pytest.fixture(scope="module")
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def frame(spark, rows):
    return spark.createDataFrame(rows, "queue string, batch_id string, kind string, t long").select("queue", "batch_id", "kind", F.timestamp_seconds("t").alias("ts"))


def judged(rows, most):
    """The same by a plain loop."""
    out, places = {}, {}
    for q, b, kind, t in sorted(rows, key=lambda r: (r[3], r[2] == "submit", r[1])):
        open_ = places.setdefault(q or "", set())
        if kind == "finish":
            open_.discard(b)
        elif kind == "submit":
            out[q or "", b, t] = (len(open_) < most, len(open_))
            if len(open_) < most:
                open_.add(b)
    return out


def read(rows):
    return {(r["queue"] or "", r["batch_id"], int(r["ts"].timestamp())): (r["accepted"], r["open"]) for r in rows}


def requests(n=300):
    rows = []
    for i in range(n):
        q, t = RNG.choice(["a", "b", None]), RNG.randint(0, 500)
        rows += [(q, f"{i:04}", "submit", t)] + ([(q, f"{i:04}", "finish", t + RNG.randint(0, 60))] if RNG.random() < 0.9 else [])
    return rows


def test_refused_requests_do_not_count(spark):
    """One place; b is refused, so its long stay does not keep c out."""
    rows = [("q", "a", "submit", 0), ("q", "a", "finish", 10), ("q", "b", "submit", 1), ("q", "b", "finish", 100), ("q", "c", "submit", 20), ("q", "c", "finish", 30)]
    got = read(queues.admission(frame(spark, rows), 1).collect())
    assert {b: ok for (_, b, _), (ok, _) in got.items()} == {"a": True, "b": False, "c": True}


@pytest.mark.parametrize("most", [1, 4, 25])
def test_admission_is_the_loop(spark, most):
    rows = requests()
    extra = [(None, None, "submit", 1), ("a", "x", "other", 1)]
    assert read(queues.admission(frame(spark, rows + extra).repartition(5), most).collect()) == judged(rows, most)
    assert queues.admission(frame(spark, rows).limit(0), most).count() == 0


def run(spark, stream, path, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.table(name).collect()


def test_admission_stream_is_the_table(rocks, tmp_path):
    """Events come in any order within the watermark, over several triggers."""
    rows = requests(120)
    last = [("a", "end", "finish", 100_000)]
    for k, part in enumerate((rows[::2], rows[1::2], last)):
        frame(rocks, part).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    schema = frame(rocks, rows).schema
    stream = rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = run(rocks, queues.admission_stream(stream, 4, "1 hour"), tmp_path / "c", "admitted", "append")
    assert read(got) == judged(rows, 4)


def changes():
    rows = []
    for b in range(40):
        t = RNG.randint(0, 50)
        for i in range(RNG.randint(1, 6)):
            rows.append((f"b{b}", f"i{i}", "queued", t))
            begun = t + RNG.randint(1, 40)
            if RNG.random() < 0.9:
                rows.append((f"b{b}", f"i{i}", "running", begun))
                if RNG.random() < 0.95:
                    rows.append((f"b{b}", f"i{i}", RNG.choice(["completed", "failed"]), begun + RNG.randint(1, 40)))
    return rows, [(f"b{b}", RNG.randint(10, 140)) for b in range(0, 40, 2)] + [("none", 3)]


def lives(rows, asked, ttl):
    out, asked = {}, dict(asked)
    for b in {r[0] for r in rows}:
        items, cancel = {}, asked.get(b)
        for r in sorted((r for r in rows if r[0] == b), key=lambda r: r[3]):
            items.setdefault(r[1], []).append(r)
        ends, kinds = [], []
        for own in items.values():
            begun = next((r[3] for r in own if r[2] != "queued"), None)
            end = next(((r[3], r[2]) for r in own if r[2] in ("completed", "failed")), (None, "open"))
            if cancel is not None and (begun is None or begun >= cancel):
                end = (cancel, "cancelled")
            ends.append(end[0])
            kinds.append(end[1] if end[1] != "open" or begun is None else "running")
        done = None not in ends
        last = max(ends) if done else None
        requested = cancel is not None and (not done or cancel <= last)
        status = ("cancelled" if requested else "completed") if done else "running" if set(kinds) & {"running", "completed", "failed"} else "queued"
        out[b] = (status, len(items), kinds.count("completed"), kinds.count("failed"), kinds.count("cancelled"), requested, last, last + ttl if done else None)
    return out


def known(rows):
    secs = lambda x: x and int(x.timestamp())
    return {r["batch_id"]: (r["status"], r["total"], r["completed"], r["failed"], r["cancelled"], r["cancel_requested"], secs(r["finished_at"]), secs(r["expires_at"])) for r in rows}


def tables(spark, rows, asked):
    made = spark.createDataFrame(rows, "batch_id string, item string, state string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    return made, spark.createDataFrame(asked, "batch_id string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")


def test_batch_life_is_the_loop(spark):
    rows, asked = changes()
    got = known(queues.batch_life(*tables(spark, rows + rows[:30], asked), 1800).collect())
    assert got == lives(rows, asked, 1800)
    assert {s for s, *_ in got.values()} == {"completed", "cancelled", "running"} or len({s for s, *_ in got.values()}) == 4
    assert queues.batch_life(*(t.limit(0) for t in tables(spark, rows, asked))).count() == 0


def test_batch_life_stream_is_the_table(rocks, tmp_path):
    rows, asked = changes()
    made, cancels = tables(rocks, rows, asked[:-1])
    events = made.unionByName(cancels.selectExpr("batch_id", "cast(null as string) AS item", "'cancel' AS state", "ts"))
    for k in range(3):
        events.where(F.pmod(F.xxhash64("batch_id", "item", "state"), F.lit(3)) == k).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    late, _ = tables(rocks, [("z", "i", "queued", 1_000_000)], asked)
    late.coalesce(1).write.parquet(str(tmp_path / "in" / "9"))
    stream = rocks.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = run(rocks, queues.batch_life_stream(stream, 1800, "1 hour"), tmp_path / "c", "lives", "update")
    want = lives(rows, asked, 1800)
    last = {}
    for r in got:
        if r["status"] != "expired":
            last[r["batch_id"]] = max(last.get(r["batch_id"], r), r, key=lambda x: (x["total"], x["completed"] + x["failed"] + x["cancelled"], x["cancel_requested"]))
    ended = known([r for r in got if r["status"] == "expired"])
    assert {b: v[1:] for b, v in ended.items()} == {b: v[1:] for b, v in want.items() if v[6] is not None}
    for b, v in want.items():
        if v[6] is None:
            assert known([last[b]])[b][1] == v[1]
