"""Labelled flow tables (CSV): schema, protocol dictionary, tabular examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom import schema as S
from flowloom.functions import tokens as K
from flowloom.operators.lookups import lookup_join
from flowloom.operators.ranks import first_n, sorted_rank
from flowloom.session import materialize


def read_labelled_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV rows; without a schema every column stays text, so there is no inference pass."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def protocol_dictionary(flows: DataFrame, proto_col: str = "proto") -> DataFrame:
    """Distinct protocol texts in sorted order with 0-based ids, and their number of rows."""
    text = F.coalesce(F.col(proto_col).cast("string"), F.lit("nan")).alias("proto")
    counts = flows.groupBy(text).agg(F.count(F.lit(1)).alias("n_rows"))
    return sorted_rank(counts, ["proto"], name="proto_id").select(
        "proto", F.col("proto_id").cast("int").alias("proto_id"), "n_rows")


def proto_vocab(dictionary: DataFrame) -> DataFrame:
    return dictionary.select(F.greatest(F.lit(2), F.count(F.lit(1)) + 1).alias("proto_vocab"))


def _column(flows: DataFrame, name: str) -> Column | None:
    found = [c for c in flows.columns if c.lower() == name]
    return F.col(found[0]) if found else None


def labelled_flows(flows: DataFrame, dictionary: DataFrame, label_col: str = "label", proto_col: str = "proto",
                   sport_col: str = "sport", dport_col: str = "dsport", exclude: list[str] | None = None,
                   max_packets: int = S.MAX_PACKETS_PER_FLOW) -> DataFrame:
    """Header fields and label per tabular row; ``fields`` keeps what the proxy bytes are drawn from.

    Fit ``dictionary`` on the training table and pass it for the test table too, so
    both share ids; a protocol unseen in training gets the id after the last one.
    ``exclude`` names columns (an attack category, say) to keep out of the proxies.
    """
    drop = {label_col, *(exclude or [])}
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in flows.columns if c not in drop]
    sport = F.col(sport_col) if sport_col in flows.columns else F.lit(0)
    dport = F.col(dport_col) if dport_col in flows.columns else F.lit(0)
    npkts = K.derived_packets(_column(flows, "spkts"), _column(flows, "dpkts"), max_packets)
    named = flows.withColumn("_proto", F.coalesce(F.col(proto_col).cast("string"), F.lit("nan")))
    ids = dictionary.select(F.col("proto").alias("_proto"), F.col("proto_id").alias("_id"), "n_rows")
    unseen = dictionary.select(F.count(F.lit(1)).cast("int")).scalar()
    return (lookup_join(named, ids, ["_proto"], "n_rows", flows.columns)
            .withColumn("proto_id", F.coalesce("_id", unseen)).drop("_proto", "_id")
            .withColumn("npkts", npkts)
            .withColumn("sport_bucket", K.port_bucket(sport)).withColumn("dport_bucket", K.port_bucket(dport))
            .withColumn("label", F.col(label_col).cast("int"))
            .withColumn("fields", F.concat_ws("|", *fields)))


def with_proxy_packets(examples: DataFrame, max_len: int = S.PAYLOAD_MAX_LEN) -> DataFrame:
    """Add ``packets``: one pseudo-payload per derived packet, and the header vector."""
    slots = F.sequence(F.lit(0), F.col("npkts") - 1)
    packets = F.transform(slots, lambda t: F.struct(
        t.alias("slot"), F.lit(max_len).alias("length"),
        K.proxy_bytes([F.col("fields")], t, max_len).alias("payload")))
    headers = F.array(F.col("proto_id"), F.col("sport_bucket"), F.col("dport_bucket"), F.col("npkts"), F.lit(0))
    return examples.withColumn("packets", packets).withColumn("headers", headers)


def first_rows(table: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of files in the order of their names and lines. A file split starts at its block, and
    inside a split identifiers rise with the lines."""
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
             F.monotonically_increasing_id().alias("_line")]
    return first_n(table.select("*", *place), [], ["_file", "_block", "_line"], n).drop("_file", "_block", "_line")


def read_labelled_flows(spark: SparkSession, train_csv: str, test_csv: str | None = None,
                        max_rows: int | None = None, **columns: str) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(train, test, dictionary) from CSV files; ``max_rows`` is a row cap of the caller's.

    Those are the first rows in file and line order. A capped table is stored, so that dictionary and examples see the same rows.
    """
    def load(path: str) -> DataFrame:
        table = read_labelled_csv(spark, path)
        return table if max_rows is None else materialize(first_rows(table, max_rows), "capped")

    train = load(train_csv)
    dictionary = protocol_dictionary(train, columns.get("proto_col", "proto"))
    test = None if test_csv is None else labelled_flows(load(test_csv), dictionary, **columns)
    return labelled_flows(train, dictionary, **columns), test, dictionary
