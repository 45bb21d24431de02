"""Benchmark decontamination as a prefix-filtered join, in DataFrame functions alone.

A window of `WINDOW` consecutive item words (all words of a shorter item) occurs in a document only if its rarest word does. So
words are ordered by how often the documents hold them, each window gives up its rarest word (its necessary prefix), and only the
places of those words in documents are joined. A place and a word's position in the item fix an alignment; bounds on position and
length drop the ones that leave the document, and the rest are compared word by word for runs of at least a window's length.

Words: A-Z lowered, then maximal runs of digits, letters a-z and characters beyond ASCII.

Defined cases: a null text has no words; an item without words or without item_id takes no part; repeated items are one; repeated
rows of documents are judged each (equal rows alike); a null doc_id is allowed; empty tables give no hits; other columns of the
documents are carried along, one named like an output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored

WINDOW = 13
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: a side of at most so many bytes, measured, is broadcast; a larger one is shuffled
BROADCAST_BYTES = 16 << 20
OUTPUT = ["n_words", "n_hit", "items", "contaminated"]


def words_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))
    return F.array_remove(F.split(folded, SEPARATOR), "")


def measured(side: DataFrame, word: str) -> DataFrame:
    """The side with a broadcast hint if its size allows one. It must be a stored table."""
    size = side.agg(F.coalesce(F.sum(F.octet_length(word) + 64), F.lit(0))).first()[0]
    return F.broadcast(side) if size <= BROADCAST_BYTES else side


def key_columns() -> list[Column]:
    """Two 64-bit hashes of a row's id and text: rows that share them are equal and share their result."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(7), "text", "doc_id").alias("k2")]


def item_words(items: DataFrame, window: int) -> DataFrame:
    """item (a string), width (of its windows), last (position of its last window), words; one row an item."""
    rows = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words"))
    rows = rows.where(F.size("words") > 0).distinct()
    width = F.least(F.size("words"), F.lit(window))
    return rows.select("item", "words", F.xxhash64("item", "words").alias("item_key"), width.alias("width"), (F.size("words") - width).alias("last"))


def necessary_words(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """word, item_key, at, first, last, width: a word at position `at` of an item is the rarest of its windows that start at
    first to last. Windows with a word that no document holds are left out: they cannot occur."""
    places = items.select("item_key", "width", F.col("last").alias("last_start"), F.posexplode("words").alias("at", "word"))
    places = places.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ahead = Window.partitionBy("item_key").orderBy("at").rowsBetween(0, window - 1)
    starts = places.withColumn("rarest", F.min(F.struct("n", "at", "word")).over(ahead)).where(F.col("at") <= F.col("last_start"))
    starts = starts.where(F.col("rarest.n") > 0)
    return starts.groupBy("item_key", F.col("rarest.at").alias("at"), F.col("rarest.word").alias("word"), "width").agg(
        F.min(starts["at"]).alias("first"), F.max(starts["at"]).alias("last"))


def runs(words: Column, item: Column, offset: Column, width: Column) -> Column:
    """Stretches [a, b) of document words that equal the item's words at this offset and are at least width long."""
    nothing = F.array().cast("array<struct<a:int,b:int>>")

    def step(acc: Column, j: Column) -> Column:
        at = j + offset
        same = F.coalesce(F.get(words, at) == F.get(item, j), F.lit(False))
        ended = F.when(acc["run"] >= width, F.concat(acc["out"], F.array(F.struct((at - acc["run"]).alias("a"), at.alias("b"))))).otherwise(acc["out"])
        return F.when(same, F.struct((acc["run"] + 1).alias("run"), acc["out"].alias("out"))).otherwise(
            F.struct(F.lit(0).alias("run"), ended.alias("out")))

    return F.aggregate(F.sequence(F.lit(0), F.size(item)), F.struct(F.lit(0).alias("run"), nothing.alias("out")), step, lambda acc: acc["out"])


def covered(stretches: Column) -> Column:
    """Words that the sorted stretches cover together."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(stretches, start, lambda acc, s: F.struct(
        F.greatest(acc["end"], s["b"]).alias("end"),
        (acc["n"] + F.greatest(s["b"] - F.greatest(s["a"], acc["end"]), F.lit(0))).alias("n")), lambda acc: acc["n"])


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text, ...) with n_words, n_hit (long), items (the ids of items with an occurring window, as sorted strings)
    and contaminated (a twentieth of the words or more is hit)."""
    item_table = stored(item_words(items, window), "items")
    places = docs.select(*key_columns(), words_of(F.col("text")).alias("words")).select(
        "k1", "k2", F.size("words").alias("n_words"), F.posexplode("words").alias("place", "word"))

    vocabulary = stored(item_table.select(F.explode("words").alias("word")).distinct(), "item-vocabulary")
    counts = places.select("word").join(measured(vocabulary, "word"), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    needed = stored(necessary_words(item_table, counts, window), "necessary-words")

    found = places.join(measured(needed, "word"), "word").withColumn("offset", F.col("place") - F.col("at"))
    inside = (F.greatest("first", -F.col("offset")) <= F.least("last", F.col("n_words") - F.col("width") - F.col("offset")))
    aligned = found.where(inside).select("k1", "k2", "item_key", "offset").distinct()
    aligned = aligned.join(item_table.select("item_key", "item", "words", "width"), "item_key")
    by_doc = aligned.groupBy("k1", "k2").agg(F.collect_list(F.struct("item", "offset", "width", "words")).alias("_aligned"))

    stay = [c for c in docs.columns if c not in OUTPUT]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in stay]).alias("row"), *key_columns())
    rows = rows.join(by_doc, ["k1", "k2"], "left")

    # the words are bound once a row, and the generator keeps a later filter on the result from computing them anew for each word
    def judged(own: Column) -> Column:
        hits = F.transform("_aligned", lambda c: F.struct(c["item"].alias("item"), runs(own, c["words"], c["offset"], c["width"]).alias("runs")))
        return F.struct(F.size(own).cast("long").alias("n_words"), hits.alias("hits"))

    rows = rows.select("row", F.inline_outer(F.transform(F.array(words_of(F.col("row.text"))), judged)))
    hit = F.filter("hits", lambda h: F.size(h["runs"]) > 0)
    rows = rows.select("row", "n_words", F.coalesce(hit, F.array().cast("array<struct<item:string,runs:array<struct<a:int,b:int>>>>")).alias("hits"))
    n_hit = covered(F.array_sort(F.flatten(F.transform("hits", lambda h: h["runs"])))).cast("long")
    rows = rows.select("row", "n_words", n_hit.alias("n_hit"), F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item"]))).alias("items"))
    return rows.select("row.*", "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
