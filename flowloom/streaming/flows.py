"""Flows of a packet stream: arrival index and flow windows, kept as keyed state with event-time timers.

Both operators hold at most ``max_packets`` packets of a flow, the earliest ones, whatever the flow sends; the payload
has left before (``slim``) or is kept only for packets inside the cap. A packet is settled once the watermark has
passed it: nothing earlier can follow, since rows at or behind the watermark of the batch before are dropped as late
(and counted in the query's ``numRowsDroppedByWatermark``). So results do not depend on how packets are dealt over
micro-batches, as long as they come inside the lateness and a flow does not outlive its state.

State is kept per shard: flows are dealt by a hash of their key, and a micro-batch reads and writes the shards that it
touches. The shards should follow the flows that are in state at a time, some thousands of packets each: fewer cost
longer values, more cost calls of the state store.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowloom import schema as S
from flowloom.functions import signatures as G

# Event time in milliseconds, as timers count it.
TIME = "_ms"
TIES = ["flags", "ttl", "payload_len"]
# Shards of a stream's flows, and of one window's.
SHARDS, WINDOW_SHARDS = 256, 16


class FirstPackets(StatefulProcessor):
    """State shared by both operators: the flows of one shard and of each its earliest packets, at most ``cap`` of them.

    ``key`` tells a shard's flows apart, ``columns`` are stored per packet, ``order`` gives their order; ``out`` names
    the result's columns. A flow is a list that ends with its waiting packets. All flows of a shard are one stored value
    with one timer, the earliest of theirs, so calls of the state store follow the shards and not the flows.
    """

    def __init__(self, key: list[str], columns: list[str], order: list[str], cap: int, out: list[str]):
        self.key, self.columns, self.cap, self.out = key, columns, cap, out
        self.order = [columns.index(c) for c in order]
        self.time = columns.index(TIME)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("flows", "due BIGINT, flows BINARY")
        self.row = Row(*self.out)

    def rank(self, packet: tuple) -> tuple:
        return tuple((packet[i] is not None, packet[i]) for i in self.order)

    def load(self) -> tuple[int | None, dict[tuple, list]]:
        kept = self.kept.get()
        return (kept[0], pickle.loads(kept[1])) if kept else (None, {})

    def store(self, flows: dict[tuple, list], due: int | None) -> None:
        if flows:
            self.kept.update((due, pickle.dumps(flows, 5)))
        else:
            self.kept.clear()

    def add(self, rows: Iterator[Row], flows: dict[tuple, list]) -> set[tuple]:
        """Put ``rows`` among the waiting packets of their flows; returns the keys of these flows."""
        touched, key, stored = set(), None, None
        for r in rows:
            if key is None:
                key, stored = ([r.__fields__.index(c) for c in names] for names in (self.key, self.columns))
            values = tuple(r)
            k, packet = tuple(values[i] for i in key), tuple(values[i] for i in stored)
            flow = flows.get(k)
            if flow is None:
                flow = flows[k] = self.new()
            touched.add(k)
            room, waiting = self.room(flow, packet), flow[-1]
            if room > 0:
                waiting.append(packet)
                if len(waiting) > 64 * self.cap:  # a long batch of one flow is cut on the way
                    waiting.sort(key=self.rank)
                    del waiting[room:]
        for k in touched:
            waiting = flows[k][-1]
            waiting.sort(key=self.rank)
            del waiting[self.cap:]
        return touched

    def close(self) -> None:
        pass


class Indexer(FirstPackets):
    """Gives settled packets their index; a flow that stays quiet for ``idle`` milliseconds is forgotten. A flow is
    [indexes given, latest time, waiting packets]."""

    def __init__(self, key: list[str], columns: list[str], order: list[str], cap: int, out: list[str], idle: int):
        super().__init__(key, columns, order, cap, out)
        self.idle = idle

    def new(self) -> list:
        return [0, 0, []]

    def room(self, flow: list, packet: tuple) -> int:
        flow[1] = max(flow[1], packet[self.time])
        return self.cap - flow[0]

    def due(self, flow: list) -> int:
        given, last, waiting = flow
        return min(waiting[0][self.time], last + self.idle) if waiting else last + self.idle

    def handleInputRows(self, key, rows, timerValues):
        before, flows = self.load()
        touched = self.add(rows, flows)
        for k in touched:
            given, _, waiting = flows[k]
            del waiting[self.cap - given:]
        first = min(self.due(flows[k]) for k in touched)
        due = first if before is None else min(before, first)
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
        self.store(flows, due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        _, flows = self.load()
        kept, due = {}, None
        for k, flow in flows.items():
            given, last, waiting = flow
            ready = [p for p in waiting if p[self.time] <= mark]
            for i, p in enumerate(ready):
                yield self.row(*k, *p, given + i)
            rest = waiting[len(ready):]
            if rest or last + self.idle > mark:
                kept[k] = flow = [given + len(ready), last, rest]
                # With packets waiting a flow outlives its last time: the next thing to happen is the first of them.
                at = rest[0][self.time] if rest else last + self.idle
                due = at if due is None else min(due, at)
        if due is not None:
            self.handle.registerTimer(due)
        self.store(kept, due)


class Windower(FirstPackets):
    """Counts a window's packets of a flow and gives them out with the earliest ones when the window has ended. A flow
    is [packets, waiting packets]; a shard belongs to one window."""

    def new(self) -> list:
        return [0, []]

    def room(self, flow: list, packet: tuple) -> int:
        flow[0] += 1
        return self.cap

    def handleInputRows(self, key, rows, timerValues):
        before, flows = self.load()
        self.add(rows, flows)
        if before is None:
            self.handle.registerTimer(key[0])
        self.store(flows, key[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        _, flows = self.load()
        self.kept.clear()
        for k, (n, waiting) in flows.items():
            yield self.row(key[0], *k, n, [dict(zip(self.columns, p)) for p in waiting])


def _shard(key: list[str], shards: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(shards)).cast("int")


def _timed(packets: DataFrame, late: str) -> DataFrame:
    return packets.withWatermark("ts", late).withColumn(TIME, F.unix_millis("ts"))


def packet_index(packets: DataFrame, key: list[str] | None = None, order: list[str] | None = None,
                 max_packets: int = S.MAX_PACKETS_PER_FLOW, late: str = "1 minute", idle_ms: int = 3_600_000,
                 shards: int = SHARDS) -> DataFrame:
    """The streaming form of ``operators.flows.packet_index``; needs ``ts``, which must not run against ``order``.

    A packet comes out, with its 0-based index, once the watermark has passed it; packets beyond the cap never do. A
    flow loses its state when the watermark is ``idle_ms`` past its last packet, and what follows starts a new flow.
    ``shards`` can't be changed once a stream has started.
    """
    key = key or S.FLOW_KEY
    timed = _timed(packets, late)
    stored = T.StructType([f for f in timed.schema if f.name not in key])
    out = T.StructType([timed.schema[c] for c in key] + stored.fields + [T.StructField("packet_index", T.IntegerType())])
    processor = Indexer(key, stored.fieldNames(), [TIME, *(order or ["arrival"])], max_packets, out.fieldNames(), idle_ms)
    return (timed.withColumn("_shard", _shard(key, shards)).groupBy("_shard")
            .transformWithState(processor, out, "Append", "EventTime").drop(TIME))


def window_end(width: str) -> Column:
    return F.window("ts", width)["end"]


def flow_windows(packets: DataFrame, width: str = "1 minute", late: str = "1 minute",
                 max_packets: int = S.MAX_PACKETS_PER_FLOW, registry: dict[int, G.Signature] | None = None,
                 shards: int = WINDOW_SHARDS) -> DataFrame:
    """One row per flow and window of ``width``: end, FLOW_KEY, packets (all of them), and the flow columns of
    ``operators.flows.summarize_flows`` over the window's first packets. A row comes out once the watermark has passed
    the window; windows stand for captures from here on. ``shards`` are those of one window."""
    from flowloom.operators.flows import slim

    slimmed = slim(packets, registry)
    timed = _timed(slimmed.withColumn("_end", F.unix_millis(window_end(width))), late)
    kept = ["arrival", "flags", "ttl", "payload_len", "rule_bits", "signature"]
    stored = T.StructType([timed.schema[c] for c in [TIME, *kept]])
    key = ["_end", *S.FLOW_KEY]
    out = T.StructType([timed.schema[c] for c in key] + [
        T.StructField("packets", T.LongType()), T.StructField("firsts", T.ArrayType(stored))])
    processor = Windower(S.FLOW_KEY, stored.fieldNames(), ["arrival", *TIES], max_packets, out.fieldNames())
    rows = (timed.withColumn("_shard", _shard(S.FLOW_KEY, shards)).groupBy("_end", "_shard")
            .transformWithState(processor, out, "Append", "EventTime"))
    return summarize_firsts(rows.withColumn("end", F.timestamp_millis("_end")).drop("_end"))


def summarize_firsts(rows: DataFrame) -> DataFrame:
    """The statistics of ``summarize_flows`` from an array of a flow's first packets, without an aggregate."""
    p = F.col("firsts")

    def each(name: str) -> Column:
        return F.transform(p, lambda x: x[name])

    def number(condition) -> Column:
        return F.size(F.filter(p, condition))

    flow = F.struct("src", "sport", "dst", "dport", "proto", p[0]["arrival"].alias("arrival"))
    flagged = F.filter(F.transform(p, lambda x, i: F.struct(
        i.alias("packet_index"), x["rule_bits"].alias("rule_bits"), F.col("src"), F.col("dst"), F.col("sport"), F.col("dport"),
        x["flags"].alias("flags"), x["payload_len"].alias("payload_len"), x["signature"].alias("signature"))),
        lambda x: x["rule_bits"] != 0)
    syn_only = number(lambda x: F.coalesce(G.bare_syn(F.col("proto"), x["flags"]), F.lit(False)))
    # Ports are part of the key: a flow has one of each.
    return rows.select(
        "end", *S.FLOW_KEY, "packets", flow.alias("first"), F.size(p).alias("n_packets"),
        F.lit(1).alias("n_distinct_src_ports"), F.lit(1).alias("n_distinct_dst_ports"), syn_only.alias("syn_only_count"),
        number(lambda x: F.coalesce(G.with_ack(F.col("proto"), x["flags"]), F.lit(False))).alias("ack_count"),
        F.array_min(each("ttl")).alias("ttl_min"), F.array_max(each("ttl")).alias("ttl_max"), flagged.alias("flagged"),
        (syn_only / F.size(p)).alias("syn_only_ratio"))
