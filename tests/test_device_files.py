import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tidemark.sources import device_files


@pytest.fixture(scope="module")
def reader(spark):
    device_files.register(spark)
    return lambda path, **o: spark.read.format("device_files").options(path=str(path), device="cam", **{"streams": "a,b", "timeColumn": "t"} | o)


@pytest.fixture(scope="module")
def parquet(tmp_path_factory):
    """Two files of 100 rows, in row groups of 30, times rising by 10 across both."""
    d = tmp_path_factory.mktemp("parquet")
    for k in range(2):
        t = [10 * i for i in range(100 * k, 100 * k + 100)]
        pq.write_table(pa.table({"t": t, "value": [x / 2 for x in t], "wide": ["x" * 50] * 100}), d / f"{k}.parquet", row_group_size=30)
    return d


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_every_stream_has_the_times(reader, parquet):
    got = rows(reader(parquet).load())
    assert got == sorted(("cam", s, 10 * i, i, f"{parquet}#stream={s}&row={i}") for s in "ab" for i in range(200))
    assert reader(parquet).load().rdd.getNumPartitions() == 16


def test_conditions_reach_the_source(reader, parquet):
    df = reader(parquet, base="mem://x").load().where("t_device_us > 500 and t_device_us <= 710 and stream_id = 'b' and seq % 2 = 0")
    assert rows(df) == [("cam", "b", 10 * i, i, f"mem://x#stream=b&row={i}") for i in range(52, 72, 2)]
    assert df.rdd.getNumPartitions() == 2  # the row groups of 30..59 and 60..89, of one stream
    plan = df._jdf.queryExecution().executedPlan().toString()
    left = plan.split("Filter", 1)[1].split("\n")[0]
    assert "t_device_us" not in left.replace("isnotnull(t_device_us", "") and "seq" in left
    assert reader(parquet).load().where("t_device_us = 990").count() == 2
    assert reader(parquet).load().where("t_device_us >= 5000").count() == 0
    assert reader(parquet).load().where(F.col("stream_id").isin("z")).count() == 0


def test_columns_and_limit(reader, parquet, spark):
    df = reader(parquet, limit=45).schema("stream_id string, value double, seq long").load()
    assert rows(df) == sorted((s, 5.0 * i, i) for s in "ab" for i in range(45))
    assert df.rdd.getNumPartitions() == 4
    assert reader(parquet, limit=0).load().count() == 0
    assert rows(reader(parquet, limit=120).load().where("t_device_us >= 1150").select("seq").distinct()) == [(i,) for i in range(115, 120)]


def test_json_lines(reader, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.json").write_text("\n".join([*(json.dumps({"t": 7 * i, "seq": i, "note": f"n{i}"}) for i in range(10 * k, 10 * k + 10)), "", json.dumps({"t": None})]))
    (tmp_path / "_hidden.json").write_text("nonsense")
    df = reader(tmp_path).schema("stream_id string, t_device_us long, seq long, note string").load()
    assert df.count() == 44 and df.rdd.getNumPartitions() == 4
    assert rows(df.where("t_device_us between 21 and 35 and stream_id = 'a'")) == [("a", 7 * i, i, f"n{i}") for i in (3, 4, 5)]
    assert sorted(r.seq for r in reader(tmp_path, limit=5, streams="a").load().collect()) == [0, 1, 2, 3, 4]
    assert reader(tmp_path, limit=15, streams="a").load().count() == 15


def test_timestamps_and_faults(reader, tmp_path):
    t = pa.array([1_704_067_200_000_000, 1_704_067_201_000_000], pa.timestamp("us"))
    pq.write_table(pa.table({"ts": t}), tmp_path / "a.parquet")
    df = reader(tmp_path / "a.parquet", timeColumn="ts", epochUs=1_704_067_200_000_000, streams="s").load()
    assert [r.t_device_us for r in df.where("t_device_us > 0").collect()] == [1_000_000]
    for wrong in ({"timeColumn": "none"}, {"streams": ""}, {"limit": -1}):
        with pytest.raises(Exception, match="column|streams|limit"):
            reader(tmp_path / "a.parquet", **{"timeColumn": "ts"} | wrong).load().count()
    with pytest.raises(Exception, match="FileNotFound"):
        reader(tmp_path / "gone").load().count()
