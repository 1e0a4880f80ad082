"""The timed stream of waits against the batch form."""

import datetime as dt
import random

from pyspark.sql import functions as F

from docprism.streaming import windows

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_timed_waits_equal_the_batch(spark, tmp_path):
    """Shuffled input in several files: each worker's last row is that of the batch; a worker idle for long starts anew."""
    rng = random.Random(6)
    began = dt.datetime(2024, 1, 1)
    made = [(rng.choice("abcd"), began + dt.timedelta(seconds=rng.randint(0, 900), milliseconds=rng.choice([0, 0, 1])), k, rng.choice([True, True, False, None])) for k in range(160)]
    rng.shuffle(made)
    schema = "worker string, ts timestamp, k long, failed boolean"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        for part in range(4):
            spark.createDataFrame(made[part::4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = windows.backoff_timed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "worker", ["ts", "k"], "failed", "20 minutes", "2 hours")
        query = stream.writeStream.foreachBatch(lambda df, n: df.withColumn("n", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "check")).outputMode("update").start()
        query.processAllAvailable()
        spark.createDataFrame([("end", began + dt.timedelta(hours=9), 900, False)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
        spark.createDataFrame([("a", began + dt.timedelta(hours=9), 901, True), ("end", began + dt.timedelta(hours=20), 902, False)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
        query.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got: dict = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("n").collect():
        got.setdefault(r.worker, []).append((r.failures, r["wait"], r.since))
    want = {r.worker: (r.failures, r["wait"], r.since) for r in windows.backoff(spark.createDataFrame(made, schema), "worker", ["ts", "k"], "failed").collect()}
    assert {w: rows[0 if w != "a" else -2] for w, rows in got.items() if w in want} == want
    assert got["a"][-1][:2] == (1, windows.FIRST_WAIT)  # forgotten in between
