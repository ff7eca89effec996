import os

from pyspark.sql import functions as F

from flowloom.functions.tokens import protocol_number
from flowloom.operators import prepare as B
from flowloom.operators.ranks import first_n, seeded_prefix
from flowloom.session import scratch_path
from flowloom.sources import flow_tables as FT
from flowloom.sources import labelled as L


def test_sources_that_look_like_numbers_stay_apart(spark):
    rows = [(s, i) for s in ("01", "1", "1.0", "2024-01-01", "plain") for i in range(20)]
    path = scratch_path(spark, "t-flows")
    FT.write_flows(spark.createDataFrame(rows, "source_file STRING, flow_id BIGINT").repartition(8), path)
    assert sorted(tuple(r) for r in FT.read_flows(spark, path).select("source_file", "flow_id").collect()) == sorted(rows)
    assert FT.read_flows(spark, path, ["1"]).count() == 20
    files = [f for _, _, names in os.walk(path.removeprefix("file://")) for f in names if f.endswith(".parquet")]
    assert len(files) <= 5 + 8  # each range task ends in the middle of one source at most


def test_split_moves_no_rows(spark):
    rows = spark.range(5000).select(F.col("id").alias("flow_id"), F.repeat(F.lit("x"), 100).alias("payload"))
    split = B.train_val_split(rows, ["flow_id"])
    assert split.filter("is_train").count() == 4500
    assert "Exchange" not in split._jdf.queryExecution().executedPlan().toString()
    whole = B.train_val_split(rows, ["flow_id"], 0.0)
    assert whole.filter("is_train").count() == 5000
    assert B.train_val_split(rows, ["flow_id"], 1.0).filter("is_train").count() == 0
    assert B.train_val_split(rows.limit(0), ["flow_id"]).count() == 0


def test_seeded_prefix_of_small_slices(spark, monkeypatch):
    from flowloom.operators import ranks

    monkeypatch.setattr(ranks, "SLICE_ROWS", 2)
    rows = spark.range(3000).select(F.col("id").alias("k"))
    order = [r["k"] for r in rows.orderBy(ranks.hash_key(["k"], 3)).collect()]
    for n in (1, 2, 1500, 2999, 3000, 5000):
        got = {r["k"] for r in rows.filter(seeded_prefix(rows, ["k"], n, 3)).collect()}
        assert got == set(order[:n])


def test_first_rows_of_a_file(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,proto,label\n" + "".join(f"{i},tcp,0\n" for i in range(5000)))
    table = L.first_rows(L.read_labelled_csv(spark, str(path)), 1234)
    assert sorted(int(r["id"]) for r in table.collect()) == list(range(1234))
    rows = spark.range(3000).repartition(7)
    assert sorted(r["id"] for r in first_n(rows, [], ["id"], 1100).collect()) == list(range(1100))


def test_whole_numbers_are_protocols_as_they_are(spark):
    df = spark.createDataFrame([(-1, "-1"), (6, "6")], "n INT, s STRING")
    got = df.select(protocol_number(F.col("n")).alias("n"), protocol_number(F.col("s")).alias("s")).collect()
    assert [r["n"] for r in got] == [-1, 6] and got[0]["s"] >= 256 and got[1]["s"] == 6
