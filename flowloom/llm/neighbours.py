"""Approximate nearest neighbours: NN-descent graph, greedy graph search.

* Equal vectors are one node; its rows come back at the end, the smallest identifiers first.
* First graph: nodes are cut into small groups by the signs of random projections, several times; groups that are too
  large are dealt at random. Within a group all distances are known, and each node keeps its nearest.
* NN-descent: every node's list (neighbours, a sample of those that point to it, itself) is joined to vectors; within a
  list each pair with an edge that the last round added is compared, and a pair that improves one end's list is sent to
  it. Rounds go on until fewer than ``LEAST_CHANGE`` of the edges change.
* Search: a query starts at its own node and at some nodes spread over the graph. Each round expands its nearest
  unexpanded nodes through joins with graph and vectors and keeps the ``POOL`` nearest. A search ends when its whole
  pool is expanded; there is no limit on rounds. The found nodes are then measured on the original vectors in double
  precision.

Half-precision vectors are what travels while the graph is built and searched, scaled so that the median of their
largest components is 1; components beyond 60000 times that are cut, those below a ten millionth of it are 0 there. All
state is keyed by node or query and bounded per key, and each round is a stored table. Lists per node are bounded
because the method samples; every vector is a node, and recall is measured against brute force in the tests.

Rows with a null id, a null vector, a null or non-finite component, a zero vector, or a length other than the most
frequent one take no part. Of rows that repeat an id the first by vector counts. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.session import materialize

NEIGHBOURS, REVERSE = 20, 12
FIRST_CUTS, GROUP, SENT_PER_GROUP = 20, 512, 5
LEAST_CHANGE = 0.1
SENT_PER_LIST = 6
POOL, EXPAND, ENTRIES = 320, 64, 32
VECTOR_BATCH = "4096"

_EDGE = pa.schema([("node", pa.int64()), ("nbr", pa.int64()), ("d", pa.float32())])
_EDGE_DDL = "node bigint, nbr bigint, d float"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(True))
                       & F.exists("vec", lambda x: x != 0))
    rows = rows.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    return (rows.join(F.broadcast(common), F.size("vec") == F.col("n")).drop("n")
            .groupBy("vec_id").agg(F.min("vec").alias("vec")))


def _same_vector() -> list[Column]:
    return [F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2")]


# --- pieces that run in tasks ------------------------------------------------------------

def _halves(column: pa.Array) -> np.ndarray:
    """Rows of half-precision vectors as float32."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), np.float16).reshape(len(data), -1).astype(np.float32)


def _nearest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ``k`` smallest finite entries of each row."""
    if k < d.shape[1]:
        columns = np.argpartition(d, k, axis=1)[:, :k]
    else:
        columns = np.broadcast_to(np.arange(d.shape[1]), d.shape)
    rows = np.repeat(np.arange(len(d)), columns.shape[1])
    columns = columns.ravel()
    finite = np.isfinite(d[rows, columns])
    return rows[finite], columns[finite]


def distances(x: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)
    d = np.maximum(squares[:, None] + squares[None, :] - 2 * (x @ x.T), 0)
    np.fill_diagonal(d, np.inf)
    return d


def _by_group(incoming: Iterator[pa.RecordBatch], key: str,
              work: Callable[[pa.RecordBatch], tuple | None]) -> Iterator[pa.RecordBatch]:
    """Edges of ``work`` on each run of equal keys; rows come sorted by the key, groups may span batches."""
    held: pa.Table | None = None
    out: list[tuple] = []

    def flush(table: pa.Table, last: bool) -> pa.Table | None:
        keys = table[key].to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        whole = len(cuts) - 1 if last else len(cuts) - 2
        for i in range(whole):
            found = work(table.slice(cuts[i], cuts[i + 1] - cuts[i]))
            if found is not None and len(found[0]):
                out.append(found)
        return None if last else table.slice(cuts[whole])

    def edges() -> pa.RecordBatch:
        arrays = [np.concatenate(x) for x in zip(*out)]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, _EDGE)], schema=_EDGE)

    for batch in incoming:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            held = flush(pa.concat_tables([held, table]).combine_chunks() if held is not None else table, False)
            if out:
                yield edges()
    if held is not None and held.num_rows:
        flush(held.combine_chunks(), True)
        if out:
            yield edges()


def _all_in_group(table: pa.Table, k: int) -> tuple:
    ids, x = table["node"].to_numpy(), _halves(table["v"])
    d = distances(x)
    rows, columns = _nearest(d, k)
    return ids[rows], ids[columns], d[rows, columns]


def _local_join(table: pa.Table) -> tuple | None:
    """Pairs of a list, at least one end fresh in it, that beat an end's farthest neighbour."""
    fresh = table["fresh"].to_numpy() > 0
    if not fresh.any():
        return None
    ids, x, bound = table["node"].to_numpy(), _halves(table["v"]), table["bound"].to_numpy()
    d = distances(x)
    d[(d >= bound[:, None]) | ~(fresh[:, None] | fresh[None, :])] = np.inf
    rows, columns = _nearest(d, SENT_PER_LIST)
    return ids[rows], ids[columns], d[rows, columns]


def _codes(incoming: Iterator[pa.RecordBatch], cuts: int, bits: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("cut", pa.int32()), ("code", pa.int64()), ("node", pa.int64()), ("v", pa.binary())])
    for batch in incoming:
        if not batch.num_rows:
            continue
        x = _halves(batch["v"])
        for cut in range(cuts):
            planes = np.random.default_rng(cut).standard_normal((x.shape[1], bits)).astype(np.float32)
            code = ((x @ planes > 0) @ (1 << np.arange(bits))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), cut, np.int32)), pa.array(code),
                                              batch["node"], batch["v"]], schema=schema)


def _half_vectors(incoming: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("node", pa.int64()), ("v", pa.binary())])
    for batch in incoming:
        vectors = [(np.array(v, np.float64) / scale).clip(-60000, 60000).astype(np.float16).tobytes()
                   for v in batch["vec"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array(vectors, pa.binary())], schema=schema)


def _measure(incoming: Iterator[pa.RecordBatch], half: bool) -> Iterator[pa.RecordBatch]:
    """Distances of (x, y) rows: squared in half precision, up to ``worst``, or Euclidean on doubles."""
    schema = pa.schema([("query", pa.int64()), ("node", pa.int64()), ("d", pa.float64())])
    for batch in incoming:
        if not batch.num_rows:
            continue
        if half:
            d = ((_halves(batch["x"]) - _halves(batch["y"])) ** 2).sum(axis=1).astype(np.float64)
        else:
            x, y = (np.array(batch[c].to_pylist(), np.float64) for c in "xy")
            d = np.sqrt(((x - y) ** 2).sum(axis=1))
        out = pa.RecordBatch.from_arrays([batch["query"], batch["node"], pa.array(d)], schema=schema)
        yield out.filter(pa.array(d <= batch["worst"].to_numpy())) if half else out


# --- graph ------------------------------------------------------------------------------

def _nearest_edges(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each node; Spark limits groups before it shuffles them."""
    best = edges.groupBy("node", "nbr").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    w = Window.partitionBy("node").orderBy("d", "nbr")
    return best.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def _pointing(graph: DataFrame, n: int) -> DataFrame:
    """(list, node, fresh): a sample of ``n`` nodes that have ``list`` among their neighbours. The order is fixed, so
    that a node enters a sample by a new edge."""
    w = Window.partitionBy("nbr").orderBy(F.xxhash64("node"), "node")
    return (graph.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
            .select(F.col("nbr").alias("list"), "node", "fresh"))


def first_graph(nodes: DataFrame, n: int) -> DataFrame:
    bits = max(0, int(np.log2(max(1, n) / (GROUP / 2))))
    coded = materialize(nodes.mapInArrow(lambda it: _codes(it, FIRST_CUTS, bits),
                                         "cut int, code bigint, node bigint, v binary"), "projected")
    sizes = coded.groupBy("cut", "code").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
    part = F.pmod(F.xxhash64("node", "cut"), F.col("parts"))
    group = F.xxhash64("cut", "code", part).alias("group")
    dealt = coded.join(sizes, ["cut", "code"]).select(group, "node", "v")
    edges = (dealt.repartition("group").sortWithinPartitions("group")
             .mapInArrow(lambda it: _by_group(it, "group", lambda t: _all_in_group(t, SENT_PER_GROUP)), _EDGE_DDL))
    return materialize(_nearest_edges(edges.filter("node <> nbr").withColumn("fresh", F.lit(1)), NEIGHBOURS), "graph")


def neighbour_graph(nodes: DataFrame, n: int) -> DataFrame:
    """NN-descent: node, nbr, d (squared)."""
    graph = first_graph(nodes, n)
    changed = n * NEIGHBOURS
    while changed > LEAST_CHANGE * NEIGHBOURS * n:
        bound = graph.groupBy("node").agg(F.max("d").alias("far"), F.count(F.lit(1)).alias("n"))
        bounded = (nodes.join(bound, "node", "left")
                   .select("node", "v", F.when(F.col("n") >= NEIGHBOURS, F.col("far"))
                           .otherwise(float("inf")).cast("float").alias("bound")))
        lists = (graph.select(F.col("node").alias("list"), F.col("nbr").alias("node"), "fresh")
                 .unionByName(_pointing(graph, REVERSE))
                 .unionByName(nodes.select(F.col("node").alias("list"), "node", F.lit(0).alias("fresh")))
                 .groupBy("list", "node").agg(F.max("fresh").alias("fresh")))
        joined = lists.join(bounded, "node").select("list", "node", "v", "bound", "fresh")
        found = (joined.repartition("list").sortWithinPartitions("list")
                 .mapInArrow(lambda it: _by_group(it, "list", _local_join), _EDGE_DDL))
        graph = materialize(_nearest_edges(graph.withColumn("fresh", F.lit(0))
                                           .unionByName(found.withColumn("fresh", F.lit(1))), NEIGHBOURS), "graph")
        changed = graph.filter("fresh = 1").count()
    return graph


# --- search -----------------------------------------------------------------------------

def _pools(pools: DataFrame | None, found: DataFrame) -> DataFrame:
    """Merge measured nodes into each query's pool of (d, node, expanded)."""
    new = found.groupBy("query").agg(F.collect_set(
        F.struct("d", "node", F.lit(False).alias("expanded"))).alias("new"))
    if pools is None:
        return new.select("query", F.slice(F.array_sort("new"), 1, POOL).alias("pool"))
    joined = pools.withColumn("known", F.transform("pool", lambda c: c["node"])).join(new, "query", "left")
    unknown = F.filter(F.coalesce("new", F.array().cast(new.schema["new"].dataType)),
                       lambda c: ~F.array_contains("known", c["node"]))
    return joined.select("query", F.slice(F.array_sort(F.concat("pool", unknown)), 1, POOL).alias("pool"))


def search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Nearest nodes found: query, pool. queries: query, node (its place in the graph), v."""
    adjacency = materialize(graph.select("node", "nbr").unionByName(
        _pointing(graph, NEIGHBOURS).select(F.col("list").alias("node"), F.col("node").alias("nbr")))
        .distinct(), "adjacency")
    vectors = queries.select("query", F.col("v").alias("x"))

    def measured(pairs: DataFrame, asked: DataFrame) -> DataFrame:
        rows = (pairs.join(nodes, "node").withColumnRenamed("v", "y").join(asked, "query")
                .select("query", "node", "x", "y", "worst"))
        return rows.mapInArrow(lambda it: _measure(it, True), "query bigint, node bigint, d double")

    entries = (nodes.select("node").filter(F.pmod(F.xxhash64("node"), F.lit(max(1, n // ENTRIES))) == 0)
               .orderBy(F.xxhash64("node"), "node").limit(2 * ENTRIES))
    # 2 * ENTRIES rows at most beside each query: a stated set of starts, not a product of tables.
    starts = [r["node"] for r in entries.collect()]
    begin = queries.select("query", F.explode(F.concat(F.array("node"), F.array(*map(F.lit, starts))
                                                       .cast("array<bigint>"))).alias("node")).distinct()
    infinite = F.lit(float("inf"))
    pools = materialize(_pools(None, measured(begin, vectors.withColumn("worst", infinite))), "pools")
    while True:
        near = F.slice(F.filter("pool", lambda c: ~c["expanded"]), 1, EXPAND)
        # Nothing beyond the last of a full pool can enter it.
        worst = F.when(F.size("pool") >= POOL, F.element_at("pool", -1)["d"]).otherwise(infinite)
        chosen = pools.withColumn("chosen", F.transform(near, lambda c: c["node"])).withColumn("worst", worst)
        steps = chosen.select("query", F.explode("chosen").alias("node"))
        if steps.isEmpty():
            return pools
        pairs = steps.join(adjacency, "node").select("query", F.col("nbr").alias("node")).distinct()
        marked = chosen.select("query", F.transform("pool", lambda c: F.struct(
            c["d"].alias("d"), c["node"].alias("node"),
            (c["expanded"] | F.array_contains("chosen", c["node"])).alias("expanded"))).alias("pool"))
        asked = vectors.join(chosen.filter(F.size("chosen") > 0).select("query", "worst"), "query")
        pools = materialize(_pools(marked, measured(pairs, asked)), "pools")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """For each row whose id is divisible by ``every``: query_id, rank, vec_id, score of the ``k`` nearest found."""
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", VECTOR_BATCH)
    rows = materialize(usable(vectors).select("vec_id", "vec", *_same_vector()), "vectors")
    groups = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("node"))
    placed = materialize(rows.join(groups, ["h1", "h2"]).select("vec_id", "node", "vec"), "placed")
    exact = placed.filter(F.col("vec_id") == F.col("node")).select("node", "vec")
    largest = F.array_max(F.transform("vec", F.abs))
    scale = exact.agg(F.percentile_approx(largest, 0.5).alias("m")).first()["m"] or 1.0
    nodes = materialize(exact.mapInArrow(lambda it: _half_vectors(it, scale), "node bigint, v binary"), "nodes")
    n = nodes.count()
    graph = neighbour_graph(nodes, n)
    asked = placed.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query"), "node")
    pools = search(materialize(asked.join(nodes, "node"), "queries"), graph, nodes, n)

    found = pools.select("query", F.explode("pool").alias("c")).select("query", F.col("c.node").alias("node"))
    x = placed.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query"), F.col("vec").alias("x"))
    scored = (found.join(exact.withColumnRenamed("vec", "y"), "node").join(x, "query")
              .select("query", "node", "x", "y")
              .mapInArrow(lambda it: _measure(it, False), "query bigint, node bigint, d double"))
    # k + 1 rows of a node are enough for any query, its own row among them.
    w = Window.partitionBy("node").orderBy("vec_id")
    members = (placed.select("node", "vec_id").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)
               .drop("r"))
    best = Window.partitionBy("query").orderBy("d", "vec_id")
    return (scored.join(members, "node").filter(F.col("vec_id") != F.col("query"))
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id",
                    F.col("d").alias("score")))
