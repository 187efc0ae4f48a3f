"""First arrivals of a stream, over batches and a restart."""
import datetime as dt

import numpy as np
from assayframe.operators import domain
from assayframe.streaming import arrivals
from pyspark.sql import functions as F

SCHEMA = "row long, key string, x double, ts timestamp"


def feed(spark, folder, n, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(folder / f"b{n}"))


def drained(spark, folder, out, **kw):
    """Everything that has arrived, one folder a batch, into a table; the checkpoint stays."""
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/b*")
    found = arrivals.first_arrivals(stream, "key", "row", **kw)
    q = found.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return {(r.row, r.key, r.copies) for r in spark.read.parquet(f"{out}/rows").collect()}


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_first_of_each_key_over_batches_and_a_restart(spark, tmp_path):
    feed(spark, tmp_path, 1, [(5, "a", 1.0, at(0)), (3, "a", 2.0, at(0)), (4, "b", 1.0, at(0)), (9, None, 1.0, at(0)), (None, "z", 1.0, at(0))])
    assert drained(spark, tmp_path, tmp_path / "out") == {(3, "a", 2), (4, "b", 1)}
    feed(spark, tmp_path, 2, [(1, "a", 0.0, at(1)), (7, "c", 1.0, at(1)), (7, "c", 1.0, at(1)), (2, "b", 3.0, at(1))])
    assert drained(spark, tmp_path, tmp_path / "out") == {(3, "a", 2), (4, "b", 1), (7, "c", 2)}
    assert drained(spark, tmp_path, tmp_path / "out") == {(3, "a", 2), (4, "b", 1), (7, "c", 2)}


def test_forgotten_keys_come_again(spark, tmp_path):
    for n, rows in enumerate(([(1, "a", 0.0, at(0))], [(2, "a", 0.0, at(5))], [(3, "b", 0.0, at(300))], [(4, "c", 0.0, at(301))], [(5, "a", 0.0, at(302))])):
        feed(spark, tmp_path, n, rows)
        got = drained(spark, tmp_path, tmp_path / "out", ts="ts", late="1 minute", forget="1 hour")
    assert {r for r, *_ in got} == {1, 3, 4, 5}


def test_domain_of_arrivals(spark):
    x = np.random.default_rng(1).normal(size=(60, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    inverse = domain.augmented_inverse(df, "x", 3)
    new = spark.createDataFrame([(1, [0.0, 0.0, 0.0]), (2, [9.0, 9.0, -9.0])], "id long, x array<double>")
    got = {r.id: r for r in arrivals.with_domain(new, "x", inverse, 60).collect()}
    full = np.concatenate((np.ones((60, 1)), x), 1)
    z = np.array([1, 9, 9, -9.0])
    assert got[1].in_domain and not got[2].in_domain and abs(got[2].leverage - z @ np.linalg.inv(full.T @ full) @ z) < 1e-9
