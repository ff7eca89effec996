"""Near duplicates: ProbMinHash signatures, banding, exact verification.

Shingles are five successive words (lower-cased, cut at white space); a shorter text is one shingle. A shingle weighs
1 + ln(count). In ProbMinHash every shingle is a Poisson process whose rate is its weight: it sends arrivals to
random registers at growing times, a register keeps the earliest, and a shingle stops as soon as its next arrival is
later than every register's. Two registers agree with the probability Jaccard of the two texts.

1. Exact copies share a text key and count once from here on.
2. Registers are hashed in bands; texts that share a band meet in a bucket. Of each bucket the most central text (in
   the largest buckets over all its bands) is the pivot, and only (text, pivot) pairs are verified: the share of
   common distinct shingles must be ``similarity`` or more.
3. Verified links are contracted to components; groups of copies become one component. Texts compared with the same
   pivot that are then still in different components may be alike to each other and not to the pivot. Such two must
   share elements of their differences from the pivot, and are found by a prefix join on these, so that no link of a
   bucket is lost and a family of copies, each edited elsewhere, makes few pairs. Before that, counts rule out texts
   with too many shingles that no other such text has.
4. Components of all links are the classes.

Nothing is gathered per group: buckets and components are aggregates and joins, and a pivot's shingles are repeated
for every ``PIVOT_PAIRS`` of its pairs, so a hot pivot is dealt over many tasks.

Null texts and texts without words have no shingles and link to nothing but their exact copies. A null ``doc_id``
takes part; a class of null ids only has a null class id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import ids_and_texts, keep_rows
from flowloom.operators.lookups import lookup_join
from flowloom.session import materialize

WORDS, SIMILARITY = 5, 0.8
# A pair at 0.8 is missed with probability (1 - 0.8**5)**24 < 1e-4; one at 0.3 is looked at in 6 % of all cases.
BANDS, BAND_ROWS = 24, 5
PIVOT_PAIRS = 256
MEMO_WORDS = 300_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_HALF, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, emptied when full."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return h

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > MEMO_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_hashes = WordHashes()


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Hashes of all runs of ``words`` words, with repeats, in order."""
    h = _hashes.of(text.lower().split())
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    width = min(words, len(h))
    out = np.full(n, np.uint64(width))
    for i in range(width):
        out = mix(out * _GOLDEN + h[i:i + n])
    return out


def prob_minhash(elements: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """For each register the element that arrives first. Arrivals are made in blocks, and an element leaves
    once it is later than the latest register."""
    first = np.full(registers, np.inf)
    owner = np.zeros(registers, np.uint64)
    time = np.zeros(len(elements))
    done = 0
    # Enough arrivals at once to reach all registers, as a rule.
    block = int(registers * (np.log(registers) + 2)) // max(1, len(elements)) + 1
    while len(elements):
        numbers = np.arange(done + 1, done + block + 1, dtype=np.uint64) * _GOLDEN
        x = mix(elements[:, None] + numbers[None, :])
        waits = -np.log(((x >> _HALF).astype(np.float64) + 0.5) * 2.0 ** -32) / weights[:, None]
        times = time[:, None] + np.cumsum(waits, axis=1)
        to = ((x & _LOW) * np.uint64(registers)) >> _HALF
        early = np.flatnonzero((times < first[to]).ravel())
        t, k = times.ravel()[early], to.ravel()[early]
        np.minimum.at(first, k, t)
        won = t == first[k]
        owner[k[won]] = elements[early[won] // block]
        alive = times[:, -1] < first.max()
        elements, weights, time = elements[alive], weights[alive], times[alive, -1]
        done += block
        block = 64 // max(1, len(elements)) + 1
    return owner


def signature(text: str, words: int, registers: int) -> np.ndarray | None:
    elements, counts = np.unique(shingles(text, words), return_counts=True)
    return prob_minhash(elements, 1 + np.log(counts), registers) if len(elements) else None


def band_keys(registers: np.ndarray, bands: int) -> np.ndarray:
    rows = registers.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in rows.T:
        key = mix(key * _GOLDEN + column)
    return key.view(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("key", pa.binary()), ("shingles", pa.list_(pa.int32()))])


def _sign(incoming: Iterator[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, np.ndarray] = {}
    for batch in incoming:
        keys, out = batch["key"].to_pylist(), []
        for key, text in zip(keys, batch["text"].to_pylist(), strict=True):
            if key not in known:
                if len(known) > 5_000:
                    known.clear()
                signed = signature(text, words, bands * rows)
                known[key] = band_keys(signed, bands) if signed is not None else np.empty(0, np.int64)
            out.append(known[key])
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pa.array(out, pa.list_(pa.int64()))],
                                         schema=_SIGNED)


# A filter of fixed size for the texts whose shingles are needed. When it fills up with the table, it lets more texts
# through, and the join behind it does the rest.
FILTER_SEGMENTS, SEGMENT_BITS = 64, 1 << 20


def _filter_places() -> list[Column]:
    """Segment of a key and its two bits there."""
    return [F.pmod(F.xxhash64("key"), F.lit(FILTER_SEGMENTS)).alias("segment"),
            *[F.pmod(F.xxhash64("key", F.lit(i)), F.lit(SEGMENT_BITS)).alias(f"bit{i}") for i in (1, 2)]]


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bits by segment. A segment's task gets each of its bits once, however many keys there are."""
    def fill(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros(SEGMENT_BITS, bool)
        bits[table["bit"].to_numpy()] = True
        return pa.table({"segment": [key[0].as_py()], "bits": [np.packbits(bits).tobytes()]})

    places = keys.select(*_filter_places())
    segments = (places.select("segment", F.explode(F.array("bit1", "bit2")).alias("bit")).distinct()
                .groupBy("segment").applyInArrow(fill, "segment bigint, bits binary"))
    out = np.zeros((FILTER_SEGMENTS, SEGMENT_BITS // 8), np.uint8)
    for r in segments.collect():
        out[r["segment"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _shingle_sets(incoming: Iterator[pa.RecordBatch], words: int, shared) -> Iterator[pa.RecordBatch]:
    bits, seen = shared.value, set()
    for batch in incoming:
        segment = batch["segment"].to_numpy()
        there = np.ones(len(segment), bool)
        for bit in (batch["bit1"].to_numpy(), batch["bit2"].to_numpy()):
            there &= (bits[segment, bit >> 3] >> (7 - (bit & 7)) & 1).astype(bool)
        keys, sets = [], []
        for i in np.flatnonzero(there):
            key = batch["key"][i].as_py()
            if key not in seen:  # copies in this task
                seen.add(key)
                keys.append(key)
                found = shingles(batch["text"][i].as_py(), words)
                sets.append(np.unique((found >> _HALF).astype(np.uint32)).view(np.int32))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int32()))],
                                             schema=_SETS)


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b and their shingles p, x of pairs (a, b). ``a`` may stand in most pairs: its pairs are dealt over several
    places and its set is sent to each of them."""
    places = materialize(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
                         .withColumn("places", F.ceil(F.col("n") / PIVOT_PAIRS).cast("int")), "places")
    left = (places.select("a", "places").join(sets.withColumnRenamed("key", "a"), "a")
            .select("a", F.col("shingles").alias("p"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place")))
    right = (lookup_join(pairs.select("a", "b"), places, ["a"], "n", ["b"]).join(sets.withColumnRenamed("key", "b"), "b")
             .select("a", "b", F.col("shingles").alias("x"), F.pmod(F.xxhash64("b"), F.col("places")).cast("int").alias("place")))
    return right.join(left, ["a", "place"]).select("a", "b", "p", "x")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose distinct shingles are alike."""
    common = F.size(F.array_intersect("p", "x"))
    return with_sets(pairs, sets).filter(common >= similarity * (F.size("p") + F.size("x") - common)).select("a", "b")


def pairs_by_differences(pairs: DataFrame, sets: DataFrame, component: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs (a, b) of texts that were compared with the same pivot P and are in different components.

    Of D(x), the difference of x and P, alike x and y share at least t = (|D(x)| + |D(y)| - c (|x| + |y|)) / 2 elements,
    c = (1 - s) / (1 + s), since |D(x) ^ D(y)| = |x ^ y| <= c (|x| + |y|). If x is not alike to P, t is above 0 for all
    y but P: alike texts meet in an element of their differences. With all differences in one order, they meet among the
    first |D| - t + 1; for those, a lower bound of t over all partners is taken. |D(y)| - c |y| is at least -c |P|, and
    above c |P| if y is not alike to P either. What P lacks comes first: it is rarer than what was taken from P.
    The first common element, at places i and j, leaves min(|D(x)| - i, |D(y)| - j) common ones, which must reach t.
    """
    c = (1 - similarity) / (1 + similarity)
    met = with_sets(pairs, sets)
    sides = met.select("a", "b", F.size("x").alias("size"), F.size("p").alias("pivot"),
                       F.sort_array(F.array_except("x", "p")).alias("added"), F.sort_array(F.array_except("p", "x")).alias("lost"))
    sides = sides.withColumn("d", F.size("added") + F.size("lost"))
    # Rounded down by more than the rounding of the products.
    low = (F.col("d") - c * F.col("size")) / 2 - 1e-6
    sides = (sides.withColumn("far", F.col("d") > c * (F.col("size") + F.col("pivot")) + 1e-6)
             .withColumn("among_far", F.col("d") - F.ceil(low + c * F.col("pivot") / 2) + 1)
             .withColumn("among_near", F.col("d") - F.ceil(low - c * F.col("pivot") / 2) + 1))
    first = F.when(F.col("far"), F.col("among_near")).otherwise(F.col("among_far")).cast("int")
    ordered = F.concat("added", "lost")
    rows = (sides.filter(F.col("d") > 0).join(component, sides["b"] == component["key"]).drop("key")
            .select("a", "b", "component", "size", "d", "far", "among_far",
                    F.posexplode(F.slice(ordered, F.lit(1), F.greatest(F.least(first, F.col("d")), F.lit(0)))).alias("at", "e")))
    rows = materialize(rows, "differences")
    x, y = rows.alias("x"), rows.alias("y")
    t = (F.col("x.d") + F.col("y.d") - c * (F.col("x.size") + F.col("y.size"))) / 2 - 1e-6
    tight = (F.col("x.at") < F.col("x.among_far")) & (F.col("y.at") < F.col("y.among_far"))
    same = (F.col("x.a") == F.col("y.a")) & (F.col("x.e") == F.col("y.e"))
    reach = F.least(F.col("x.d") - F.col("x.at"), F.col("y.d") - F.col("y.at")) >= t
    return (x.join(y, same & (F.col("x.component") < F.col("y.component")) & (F.col("x.far") | F.col("y.far"))
                   & (tight | ~(F.col("x.far") & F.col("y.far"))) & reach)
            .select(F.col("x.b").alias("a"), F.col("y.b").alias("b")).distinct())


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of undirected links (a, b). Every round takes the smallest label among
    the neighbours and then the label's label; it is stored, so a lost executor costs one round at most."""
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                        .distinct(), "edges")
    labels = materialize(edges.groupBy("a").agg(F.min("b").alias("m"))
                         .select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = (edges.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        hooked = labels.join(near, "node").select("node", F.col("component").alias("old"),
                                                  F.least("component", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("further"))
        new = materialize(hooked.join(jump, "label").select("node", "old", F.least("label", "further").alias("component")),
                          "labels")
        labels = new.drop("old")
        if new.filter(F.col("old") != F.col("component")).isEmpty():
            return labels


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def text_components(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS,
                    band_rows: int = BAND_ROWS) -> DataFrame:
    """One row per document: doc_id, key of its text, component."""
    texts = ids_and_texts(docs).withColumn("key", text_key(F.col("text")))
    signed = materialize(texts.mapInArrow(lambda it: _sign(it, words, bands, band_rows),
                                          "doc_id bigint, key binary, bands array<bigint>"), "signatures")
    # Same key, same bands: an aggregate that combines copies before it shuffles.
    buckets = (signed.groupBy("key").agg(F.first("bands").alias("bands"))
               .select("key", F.explode("bands").alias("bucket")))
    buckets = materialize(buckets, "buckets")
    counts = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(buckets.join(counts, "bucket"), "shared-buckets")
    central = shared.groupBy("key").agg(F.sum("n").alias("weight"))
    pivots = (shared.select("bucket", "key").join(central, "key").groupBy("bucket")
              .agg(F.max(F.struct("weight", "key"))["key"].alias("a")))
    pairs = materialize(shared.select("bucket", F.col("key").alias("b")).join(pivots, "bucket")
                        .filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "pivot-pairs")

    wanted = docs.sparkSession.sparkContext.broadcast(key_filter(shared.select("key").distinct()))
    sets = materialize(texts.select("key", *_filter_places(), "text")
                       .mapInArrow(lambda it: _shingle_sets(it, words, wanted), "key binary, shingles array<int>")
                       .groupBy("key").agg(F.first("shingles").alias("shingles")), "shingles")
    links = materialize(verified(pairs, sets, similarity), "links")
    labels = components(links)

    # What is left: pivots whose partners are in several components. Two texts can only be alike if both have enough
    # shingles that occur in another such text at all; a text with many shingles of its own has no partner.
    component = (sets.select("key").join(labels.withColumnRenamed("node", "key"), "key", "left")
                 .withColumn("component", F.coalesce("component", "key")))
    component = materialize(component, "components")
    grouped = pairs.join(component.withColumnRenamed("key", "b"), "b")
    mixed = grouped.groupBy("a").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter(F.col("low") != F.col("high"))
    open_pairs = materialize(pairs.join(mixed.select("a"), "a", "left_semi"), "open-pairs")
    open_sets = sets.join(open_pairs.select(F.col("b").alias("key")).distinct(), "key", "left_semi")
    own = (open_sets.select("key", F.explode("shingles").alias("s")).groupBy("s")
           .agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n")).filter("n = 1")
           .groupBy("key").agg(F.count(F.lit(1)).alias("own")))
    hopeful = (open_sets.select("key", F.size("shingles").alias("size")).join(own, "key", "left")
               .filter(F.col("size") - F.coalesce("own", F.lit(0)) >= similarity * F.col("size")).select(F.col("key").alias("b")))
    open_pairs = materialize(open_pairs.join(hopeful, "b", "left_semi"), "hopeful-pairs")
    rest = pairs_by_differences(open_pairs, sets, component, similarity)
    known = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = materialize(rest.join(known, ["a", "b"], "left_anti"), "rest-pairs")
    if not rest.isEmpty():
        more = verified(rest, sets, similarity)
        labels = components(materialize(links.unionByName(more), "all-links"))

    return (signed.select("doc_id", "key").join(labels.withColumnRenamed("node", "key"), "key", "left")
            .select("doc_id", "key", F.coalesce("component", "key").alias("component")))


def near_classes(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), class_size, kept (it has that id)."""
    classed = materialize(text_components(docs, **options).select("doc_id", "component"), "classed")
    classes = classed.groupBy("component").agg(F.min("doc_id").alias("class_id"),
                                               F.count(F.lit(1)).alias("class_size"))
    return (lookup_join(classed, materialize(classes.withColumn("weight", F.col("class_size")), "classes"), ["component"], "weight", ["doc_id"])
            .select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class: its smallest id, and of several texts under that id one; of rows
    that repeat both, one stays."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")).alias("first")
    kept = text_components(docs, **options).groupBy("component").agg(first).select("first.key", "first.doc_id")
    return keep_rows(docs, text_key(F.coalesce(F.col("text"), F.lit(""))), kept)
