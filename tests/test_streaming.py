from pyspark.sql import functions as F

from flowloom.session import scratch_path
from flowloom.streaming import contexts as C


def test_replay_finds_scans_and_floods(spark):
    rows = [(f"2024-01-01 00:00:{i:02d}", "10.0.0.66", "10.0.0.1", 40000, 20 + i, 6, "S") for i in range(20)]
    rows += [(f"2024-01-01 00:01:{i:02d}", f"9.0.0.{i}", "10.0.0.9", 5000 + i, 22, 6, "S") for i in range(30)]
    rows += [("2024-01-01 00:10:00", "10.0.0.5", "10.0.0.1", 1, 80, 6, "A")]
    packets = spark.createDataFrame(rows, "ts STRING, src STRING, dst STRING, sport INT, dport INT, proto INT, flags STRING"
                                    ).withColumn("ts", F.to_timestamp("ts"))
    path = scratch_path(spark, "t-stream")
    packets.write.parquet(path)
    for name, windows, finish, key in (("scans", C.source_windows, C.scans, "src"), ("floods", C.target_windows, C.floods, "dst")):
        stream = spark.readStream.schema(packets.schema).parquet(path)
        query = (finish(windows(stream)).writeStream.format("memory").queryName(name).outputMode("append")
                 .option("checkpointLocation", scratch_path(spark, "t-stream-state")).trigger(availableNow=True).start())
        query.awaitTermination(120)
        got = spark.table(name).collect()
        want = finish(windows(packets)).collect()
        assert sorted(got) == sorted(want) and [r[key] for r in got] == ["10.0.0.66" if name == "scans" else "10.0.0.9"]
