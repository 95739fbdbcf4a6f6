import random

import pytest
from pyspark.sql import functions as F
from tidemark.operators import associate, timeline
from tidemark.streaming import stateful

END = 10**12


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


class Replay:
    """Rows written as one file each time, read as a stream that stops after each and restarts from its checkpoint."""

    def __init__(self, spark, tmp_path, schema, query):
        self.spark, self.dir, self.schema = spark, tmp_path, schema
        self.query, self.n = query, 0

    def feed(self, *parts):
        for k, rows in enumerate(parts):
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.dir}/in/{self.n}")
            self.n += 1
        stream = self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{self.dir}/in")
        q = self.query(stream).writeStream.format("parquet").option("path", f"{self.dir}/out").option("checkpointLocation", f"{self.dir}/ck").trigger(availableNow=True).start()
        assert q.awaitTermination(300)
        return sorted(map(tuple, self.spark.read.parquet(f"{self.dir}/out").collect()))


def shuffled(rows, lateness, seed, t):
    """Rows in order of arrival: each is late by less than ``lateness``."""
    rng = random.Random(seed)
    return sorted(rows, key=lambda r: r[t] + rng.random() * lateness)


def thirds(rows):
    n = len(rows) // 3
    return rows[:n], rows[n : 2 * n], rows[2 * n :]


def test_association_agrees_with_the_batch_form(spark, tmp_path):
    rng = random.Random(1)
    rows = [(s, d, max(0, k * 40_000 + rng.randrange(-900, 900) * (1 + (k % 7 == 0) * 3))) for s in ("x", "y") for k in range(60) for d in "abc" if rng.random() < 0.8]
    rows += [(s, rng.choice("abc"), rng.randrange(2_400_000)) for s in ("x", "y") for _ in range(60)]
    rows += rows[5:9]
    coarse = spark.createDataFrame([("a", 1.0, 300.5), ("b", 1.00001, -250.0)], "device_id string, alpha double, beta_us double")
    replay = Replay(spark, tmp_path, "session string, device_id string, t_local_us long", lambda s: stateful.associate_stream(s, ["session"], 2500.0, coarse, late="400 milliseconds"))
    a, b, c = thirds(shuffled(rows, 300_000, 2, 2))
    early = replay.feed(a)
    assert 0 < len(early)
    replay.feed(b, c)  # restarts from the checkpoint
    got = replay.feed([("x", "a", END), ("y", "a", END)], [("x", "a", END + 10**7)])  # moves the watermark past all rows
    batch = associate.associate(spark.createDataFrame(rows, replay.schema), ["session"], 2500.0, coarse)
    want = sorted(map(tuple, batch.select("session", "event_no", "device_id", "t_local_us").collect()))
    assert got == want and len(want) > 200 and set(early) <= set(want)


def test_late_detections_are_dropped(spark, tmp_path):
    replay = Replay(spark, tmp_path, "session string, device_id string, t_local_us long", lambda s: stateful.associate_stream(s, ["session"], 100.0, late="1 second"))
    replay.feed([("x", "a", 0), ("x", "b", 50)], [("x", "c", 10_000_000)])
    got = replay.feed([("x", "c", 60), ("x", "a", 10_000_020), ("x", None, 5), ("x", "a", None), (None, "a", 10_000_030)], [("x", "z", END)])
    assert got == [("x", 0, "a", 0), ("x", 0, "b", 50), ("x", 1, "a", 10_000_020), ("x", 1, "c", 10_000_000)]
    with pytest.raises(ValueError):
        stateful.associate_stream(spark.range(1), ["id"], 0)


@pytest.mark.parametrize("kernel", ["hold", "continuous"])
def test_asof_agrees_with_the_batch_form(spark, tmp_path, kernel):
    rng = random.Random(3)
    rows = [(s, i, 1000 * i) for s in "pq" for i in range(300)]
    rows += [(s, -1, rng.choice([1000 * rng.randrange(300), rng.randrange(20_000, 280_000)])) for s in "pq" for _ in range(120)]
    rows += [("none", i, 1000 * i) for i in range(20)]  # a stream without samples

    def query(stream):
        points = stream.where("idx >= 0").select("k", F.col("idx").alias("grid_idx"), F.col("t").alias("t_us"))
        return stateful.asof_join_stream(points, stream.where("idx < 0").select("k", F.col("t").alias("t_ref_us")), ["k"], 2500, kernel, late="60 milliseconds", wait_us=100_000)

    replay = Replay(spark, tmp_path, "k string, idx long, t long", query)
    a, b, c = thirds(shuffled(rows, 50_000, 4, 2))
    early = replay.feed(a)
    replay.feed(b, c)
    got = replay.feed([("other", 0, END)], [("other", 1, END + 10**6)])
    every = spark.createDataFrame(rows, "k string, grid_idx long, t_us long")
    batch = timeline.asof_join(every.where("grid_idx >= 0"), every.where("grid_idx < 0").select("k", F.col("t_us").alias("t_ref_us")), ["k"], 2500, kernel)
    want = sorted(map(tuple, batch.collect()))
    assert [r for r in got if r[0] != "other"] == want and len(want) == 620 and 0 < len(early) < len(want) and set(early) <= set(want)


def test_points_wait_for_the_next_sample(spark, tmp_path):
    def query(stream):
        points = stream.where("idx >= 0").select("k", F.col("idx").alias("grid_idx"), F.col("t").alias("t_us"))
        return stateful.asof_join_stream(points, stream.where("idx < 0").select("k", F.col("t").alias("t_ref_us")), ["k"], 100, "continuous", late="1 second")

    replay = Replay(spark, tmp_path, "k string, idx long, t long", query)
    assert replay.feed([("k", -1, 0), ("k", 0, 50)], [("other", -1, END)], [("other", -1, END + 10**7)]) == []
    got = replay.feed([("k", -1, END + 2 * 10**7)], [("other", -1, 2 * END)])
    assert [r[:4] for r in got] == [("k", 0, 50, 0)] and got[0][4] == 1
