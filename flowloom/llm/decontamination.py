"""Benchmark passages in training texts by a positional inverted index; DataFrame functions only.

The index holds one posting (key, term, pos) for every place of a term in a training text; ``key`` stands for a text, so
that copies are indexed once, and the empty term stands behind the last word of each text. Postings lie in the shared
folder, dealt by text. An index made for one benchmark can be restricted to that benchmark's terms.

A phrase is found as in a search engine, from its rarest term on:

1. Postings of the phrase's rarest term, moved back by the term's offset, are the candidates (key, phrase, start).
2. They are intersected with the moved postings of the second rarest term. Only postings of such terms are read.
3. What is left is intersected with all other terms at once, in texts that still have a candidate: a candidate stays if
   every term stands at its offset. Nothing is hashed or sampled on the way, so matches are exact.

Candidates, intersections and postings are joined by (key, term, pos), so a frequent term, passage or text is dealt over
all tasks. ``near_phrases`` finds phrases whose terms stand in any order near their rarest term.

Words are runs of characters other than ASCII ones that are no digit or letter, with A-Z lower-cased. A window is ``size``
successive words of a benchmark item, or a whole shorter item. A null or empty text has no words and no hits; an item
without words has no window; a null item identifier reads as the empty string. Null and repeated ``doc_id`` give a
result row per row; items that repeat an identifier count once. Without documents there are no rows, without benchmark
no hits. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import ids_and_texts
from flowloom.operators.lookups import lookup_join
from flowloom.session import materialize

# Fixed value: what a word is.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
# The term behind the last word; no word is empty.
END = ""


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


# --- index ------------------------------------------------------------------------------

def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Stored postings (key, term, pos) of all distinct texts, of ``terms`` (column ``term``) only where given. The end
    of a text is always in: its place is the number of words."""
    texts = ids_and_texts(docs).groupBy(text_key(F.col("text")).alias("key")).agg(F.first("text").alias("text"))
    tokens = texts.select("key", F.posexplode(F.concat(words(F.col("text")), F.array(F.lit(END)))).alias("pos", "term"))
    if terms is not None:
        end = terms.sparkSession.createDataFrame([(END,)], "term string")
        wanted = materialize(terms.select("term").unionByName(end).distinct(), "terms")
        tokens = tokens.join(wanted, "term", "left_semi")
    return materialize(tokens.select("key", "term", "pos"), "postings")


# --- phrases ----------------------------------------------------------------------------

def windows_of(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item, window (array of words): all windows of (item, text) rows, without repeats."""
    told = items.select("item", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return (told.select("item", "w", F.explode(starts).alias("at"))
            .select("item", F.slice("w", F.col("at"), F.lit(size)).alias("window")).distinct())


def rarest_first(phrases: DataFrame, index: DataFrame) -> DataFrame:
    """phrase, width, steps: (n, offset, term) of each word from the rarest on. ``phrases`` has ``phrase`` (array of
    words); one with a word that the index lacks is left out, as it can't occur."""
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    placed = phrases.select("phrase", F.posexplode("phrase").alias("offset", "term")).join(counts, "term")
    steps = placed.groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("steps"))
    return steps.filter(F.size("steps") == F.size("phrase")).select("phrase", F.size("phrase").alias("width"), "steps")


def _intersect(found: DataFrame, guide: DataFrame, index: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """Candidates whose terms number ``first`` to ``last`` stand at their offsets; phrases without such terms pass."""
    count = F.greatest(F.size("steps") - first, F.lit(0)) if last is None else F.lit(last - first)
    todo = guide.select("id", F.slice("steps", F.lit(first + 1), count).alias("steps")).filter(F.size("steps") > 0)
    wanted = found.join(todo, "id").select("key", "id", "start", F.size("steps").alias("need"), F.explode("steps").alias("s"))
    met = wanted.select("key", "id", "start", "need", F.col("s")["term"].alias("term"),
                        (F.col("start") + F.col("s")["offset"]).alias("pos")).join(index, ["key", "term", "pos"])
    if last is None or last - first > 1:
        # A place has one posting, so the number of rows is the number of terms that are there.
        met = met.groupBy("key", "id", "start").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).filter("n = need")
    passed = found.join(todo.select("id"), "id", "left_anti")
    return met.select("key", "id", "start").unionByName(passed.select("key", "id", "start"))


def find_phrases(phrases: DataFrame, index: DataFrame) -> DataFrame:
    """Stored occurrences (key, phrase, start, width) of distinct phrases (arrays of words)."""
    guide = rarest_first(phrases.select("phrase").distinct(), index)
    guide = materialize(guide.withColumn("id", F.unhex(F.md5(F.array_join("phrase", " ")))), "phrases")
    rarest = guide.select("id", F.col("steps")[0]["term"].alias("term"), F.col("steps")[0]["offset"].alias("offset"))
    found = (index.join(rarest, "term").select("key", "id", (F.col("pos") - F.col("offset")).alias("start"))
             .filter(F.col("start") >= 0))
    found = materialize(found, "candidates")
    second = guide.select(F.get(F.col("steps"), F.lit(1))["term"].alias("term")).distinct()
    found = materialize(_intersect(found, guide, index.join(second, "term", "left_semi"), 1, 2), "candidates")
    open_texts = index.join(found.select("key").distinct(), "key", "left_semi")
    return materialize(_intersect(found, guide, open_texts, 2).join(guide.select("id", "phrase", "width"), "id")
                       .select("key", "phrase", "start", "width"), "occurrences")


def near_phrases(phrases: DataFrame, index: DataFrame, distance: int) -> DataFrame:
    """Places (key, phrase, pos) of each phrase's rarest term that have every other of its terms, in any order, at most
    ``distance`` words away. Postings are met in blocks of ``distance`` words, so no pair of far places is made."""
    guide = materialize(rarest_first(phrases.select("phrase").distinct(), index), "phrases")
    others = F.array_except(F.array_distinct(F.transform("steps", lambda s: s["term"])), F.array(F.col("steps")[0]["term"]))
    guide = guide.select("phrase", F.col("steps")[0]["term"].alias("term"), others.alias("others"))
    places = index.join(guide, "term").select("key", "phrase", "others", "pos").distinct()
    blocks = F.sequence(F.floor(F.greatest(F.col("pos") - distance, F.lit(0)) / distance), F.floor((F.col("pos") + distance) / distance))
    asked = (places.select("key", "phrase", "pos", F.size("others").alias("need"), F.explode_outer("others").alias("term"))
             .select("key", "phrase", "pos", "need", "term", F.explode(blocks).alias("block")))
    there = index.select("key", "term", F.floor(F.col("pos") / distance).alias("block"), F.col("pos").alias("at"))
    met = (asked.join(there, ["key", "term", "block"]).filter(F.abs(F.col("at") - F.col("pos")) <= distance)
           .groupBy("key", "phrase", "pos", "need", "term").agg(F.count(F.lit(1)).alias("n"))
           .groupBy("key", "phrase", "pos", "need").agg(F.count(F.lit(1)).alias("terms")).filter(F.col("terms") == F.col("need")))
    alone = places.filter(F.size("others") == 0)
    return met.select("key", "phrase", "pos").unionByName(alone.select("key", "phrase", "pos"))


# --- documents and benchmark ------------------------------------------------------------

def covered(found: DataFrame) -> DataFrame:
    """key, n_hit: words of a text inside at least one occurrence."""
    before = Window.partitionBy("key").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("key", "start", (F.col("start") + F.col("width")).alias("stop")).distinct()
    reached = F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0)))
    return (spans.withColumn("new", F.greatest(F.col("stop") - reached, F.lit(0)))
            .groupBy("key").agg(F.sum("new").alias("n_hit")))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside occurrences of windows), items (identifiers whose
    windows occur, as sorted strings)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             F.coalesce(F.col("text"), F.lit("")).alias("text"))
    windows = materialize(windows_of(items, size), "windows")
    terms = windows.select(F.explode("window").alias("term")).distinct()
    index = postings(docs, terms)
    found = find_phrases(windows.select(F.col("window").alias("phrase")), index)
    named = (found.select("key", F.col("phrase").alias("window")).distinct().join(windows, "window")
             .groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items")))

    rows = ids_and_texts(docs).select("doc_id", text_key(F.col("text")).alias("key"))
    by_text = (rows.groupBy("key").agg(F.count(F.lit(1)).alias("weight"))
               .join(index.filter(F.col("term") == END).select("key", F.col("pos").cast("bigint").alias("n_words")), "key")
               .join(covered(found), "key", "left").join(named, "key", "left"))
    joined = lookup_join(rows, materialize(by_text, "texts"), ["key"], "weight", ["doc_id"])
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
                         F.coalesce("items", F.array().cast("array<string>")).alias("items"))
