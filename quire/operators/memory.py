"""Remembered structure choices: fingerprints, recall, and the bounded memory itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from .tokens import upto

KEY = ["owner", "shape", "titles"]


def fingerprints(sects: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, shape, titles, tags, levels, options, is_default) of every structure, from sections and items apart."""
    i = items.groupBy("doc_id", "h1_ord").agg(F.array_sort(F.collect_list(F.struct("h2_ord", "text", "option", "word_option"))).alias("items"))
    none = F.array().cast(i.schema["items"].dataType)
    return fingerprints_of(sects.join(i, ["doc_id", "h1_ord"], "left").withColumn("items", F.coalesce("items", none)))


def fingerprints_of(sects: DataFrame) -> DataFrame:
    """(doc_id, shape, titles, title_text, tags, levels, options, is_default) of every structure, from sections that hold their items: one aggregate
    on the documents' placement."""
    lvl = F.when(F.col("idx") == 0, 1).otherwise(F.coalesce("word_level", F.lit(1)))
    over = lambda name: F.transform("items", lambda x: x[name])
    with_head = lambda head, rest: F.concat(F.array(head), rest)
    s = sects.select(
        "doc_id", "h1_ord", "level", over("option").alias("options"), F.size("items").cast("string").alias("n"),
        F.transform(with_head(F.col("title"), over("text")), T.normalize_title).alias("t"),
        with_head(F.coalesce(F.col("word_level").cast("string"), F.lit("-")), F.transform("items", lambda x: F.coalesce(x["word_option"], F.lit("-")))).alias("tag"),
        ((F.col("level") == lvl) & F.forall("items", lambda x: x["option"] == F.coalesce(x["word_option"], F.lit("html")))).alias("std"))
    d = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("h1_ord", "level", "options", "n", "t", "tag"))).alias("secs"),
                                F.bool_and("std").alias("is_default"))
    part = lambda name: F.transform("secs", lambda x: x[name])
    d = d.withColumn("title_text", F.array_join(F.flatten(part("t")), "\n")).withColumn("tag_list", F.flatten(part("tag")))
    tagged = F.exists("tag_list", lambda x: x != "-")
    return d.select("doc_id", F.array_join(part("n"), ",").alias("shape"), T.fnv1a(F.col("title_text")).alias("titles"), "title_text",
                    F.when(tagged, F.array_join("tag_list", ",")).otherwise("").alias("tags"),
                    part("level").alias("levels"), F.flatten(part("options")).alias("options"), "is_default")


def parse_entries(stored: DataFrame, col: str = "value") -> DataFrame:
    """(owner, ord, shape, titles, tags, levels, options, at) from stored JSON arrays;
    unreadable stores are empty and invalid entries are dropped."""
    schema = "array<struct<shape:string,titles:string,tags:string,levels:array<int>,options:array<string>,at:bigint>>"
    e = stored.select("owner", F.posexplode_outer(F.from_json(col, schema)).alias("ord", "e")).select("owner", "ord", "e.*")
    ok = (F.col("shape").isNotNull() & F.col("titles").isNotNull() & F.col("at").isNotNull() & F.col("levels").isNotNull()
          & F.col("options").isNotNull() & F.forall("levels", lambda x: F.coalesce(x.isin(fixed.PAGE_LEVELS), F.lit(False)))
          & F.forall("options", lambda x: F.coalesce(x.isin(fixed.H2_OPTIONS), F.lit(False))))
    return e.filter(ok)


def remember(events: DataFrame, limit: int = fixed.MEMORY_LIMIT, width: int = 86_400_000) -> DataFrame:
    """The memory after all events(owner, shape, titles, at, is_default, …), newest first
    (`rank`). `at` orders the events of an owner.

    An event replaces the entry of its key, a default one deletes it, and the entry beyond
    `limit` is lost for good, even if newer ones are deleted later. Without walking the
    events: survivors are among the `limit` newest keys whose last event is not a
    deletion, and one of those was lost exactly if at some moment `limit` newer entries
    were there. That count is a running sum of +1 and -1, taken per stretch of `width` time
    units and then over the stretches, so a busy owner's events spread over many tasks.
    """
    last = events.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in events.columns if c not in KEY]), "at").alias("e"))
    kept = last.select(*KEY, "e.*").filter("not is_default")
    newest = Window.partitionBy("owner").orderBy(F.col("at").desc())
    cand = kept.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= limit)

    # state of the key just before each event, through per-stretch lags
    ev = events.select(*KEY, "at", (~F.col("is_default")).alias("sets")).withColumn("chunk", F.floor(F.col("at") / width))
    op = F.struct("at", "sets")
    inner = Window.partitionBy(*KEY, "chunk").orderBy("at")
    ev = ev.withColumn("prev", F.lag(op).over(inner))
    ends = ev.groupBy(*KEY, "chunk").agg(F.max(op).alias("end"))
    ends = ends.withColumn("carry", F.lag("end").over(Window.partitionBy(*KEY).orderBy("chunk"))).drop("end")
    ev = ev.join(ends, [*KEY, "chunk"]).withColumn("prev", F.coalesce("prev", "carry"))

    # only owners with deletions can lose an entry that the ranking keeps
    c = cand.join(events.filter("is_default").select("owner").distinct(), "owner", "left_semi")
    c = c.groupBy("owner").agg(F.collect_list(F.struct(F.col("at").alias("t"), F.col("rank").alias("r"))).alias("cs"), F.min("at").alias("t0"))
    pairs = ev.join(c, "owner").filter(F.col("at") > F.col("t0")).select("owner", "chunk", "at", "sets", "prev", F.explode("cs").alias("c")).filter("at > c.t")
    was = F.coalesce(F.col("prev.sets") & (F.col("prev.at") > F.col("c.t")), F.lit(False))
    pairs = pairs.withColumn("delta", F.when(F.col("sets") & ~was, 1).when(~F.col("sets") & was, -1).otherwise(0)).filter("delta <> 0")
    run = Window.partitionBy("owner", "c.r", "chunk").orderBy("at")
    local = (pairs.withColumn("run", F.sum("delta").over(upto(run))).groupBy("owner", F.col("c.r").alias("rank"), "chunk")
             .agg(F.sum("delta").alias("total"), F.max("run").alias("peak")))
    over = Window.partitionBy("owner", "rank").orderBy("chunk")
    base = F.coalesce(F.sum("total").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lost = local.withColumn("peak", F.col("peak") + base).groupBy("owner", "rank").agg(F.max("peak").alias("peak")).filter(F.col("peak") >= limit)
    alive = cand.join(lost.select("owner", "rank"), ["owner", "rank"], "left_anti")
    return alive.withColumn("rank", F.row_number().over(newest)).drop("is_default")


def recall(structures: DataFrame, memory: DataFrame) -> DataFrame:
    """(doc_id, kind, levels, options): the remembered choices a structure gets.

    structures(doc_id, owner, shape, titles, tags, n_sections, n_items). Entries of equal
    shape and tags count; equal titles win, else the newest. Both are reduced to one row
    per join key first, so no key can multiply rows.
    """
    entry = F.struct("levels", "options")
    mem = memory.withColumn("tags", F.coalesce("tags", F.lit("")))
    same = mem.groupBy("owner", "shape", "tags", "titles").agg(F.max_by(entry, "at").alias("same"))
    newest = mem.groupBy("owner", "shape", "tags").agg(F.max_by(entry, "at").alias("newest"))
    s = (structures.join(same, ["owner", "shape", "tags", "titles"], "left").join(newest, ["owner", "shape", "tags"], "left"))
    e = F.coalesce("same", "newest")
    fits = (F.size(e["levels"]) == F.col("n_sections")) & (F.size(e["options"]) == F.col("n_items"))
    return s.filter(fits).select("doc_id", F.when(F.col("same").isNotNull(), "same").otherwise("similar").alias("kind"),
                                 e["levels"].alias("levels"), e["options"].alias("options"))


GROUP = ["owner", "shape", "tags"]


def in_ranges(events: DataFrame, width: int) -> DataFrame:
    """Events placed by (owner, shape, tags) and the range of `width` time units they lie in, so that a busy owner is dealt over many tasks.
    Events without owner have no memory and are left out."""
    ev = events.filter("owner is not null").withColumn("tags", F.coalesce("tags", F.lit(""))).withColumn("range", F.floor(F.col("at") / width))
    return ev.repartition(*GROUP, "range")


def recall_history(events: DataFrame, width: int = 86_400_000) -> DataFrame:
    """What every one of events(doc_id, owner, shape, titles, tags, levels, options, at, is_default) recalls from all older ones of its
    owner: (doc_id, kind, levels, options), only where there is something to recall.

    An as-of join without a join on the owner: the newest older entry is a running maximum per (owner, shape, tags), and one per titles besides.
    It is taken within ranges of `at` and carried from range to range, so no key's history meets in one task: a task holds a key's events of
    one range, and the carry one row a range. The events are read three times: hand in a stored table. Events of one moment do not see each other; a default event asks but leaves nothing.
    """
    ev = in_ranges(events, width)
    entry = F.when(~F.col("is_default"), F.struct("at", "doc_id", "levels", "options"))

    def older(key: list[str]) -> Column:
        return F.max(entry).over(Window.partitionBy(*key, "range").orderBy("at").rangeBetween(Window.unboundedPreceding, -1))

    def carried(key: list[str], name: str) -> DataFrame:
        ends = ev.groupBy(*key, "range").agg(F.max(entry).alias("end"))
        earlier = Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        return ends.select(*key, "range", F.max("end").over(earlier).alias(name)).filter(F.col(name).isNotNull())

    titles = [*GROUP, "titles"]
    rows = ev.withColumn("similar", older(GROUP)).withColumn("same", older(titles))
    rows = rows.join(carried(GROUP, "_similar"), [*GROUP, "range"], "left").join(carried(titles, "_same"), [*titles, "range"], "left")
    rows = rows.withColumns({"similar": F.coalesce("similar", "_similar"), "same": F.coalesce("same", "_same")})
    e = F.coalesce("same", "similar")
    fits = (F.size(e["levels"]) == F.size("levels")) & (F.size(e["options"]) == F.size("options"))
    return rows.filter(fits).select("doc_id", F.when(F.col("same").isNotNull(), "same").otherwise("similar").alias("kind"),
                                    e["levels"].alias("levels"), e["options"].alias("options"))


def apply_recalled(sects: DataFrame, items: DataFrame, recalled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections and items with the recalled levels and options put back by position."""
    r = recalled.select("doc_id", "levels", "options")
    s = sects.join(r, "doc_id", "left").withColumn("level", F.coalesce(F.get("levels", F.col("idx")), "level")).drop("levels", "options")
    i = items.join(r, "doc_id", "left").withColumn("option", F.coalesce(F.get("options", F.col("h2_ord") - 1), "option")).drop("levels", "options")
    return s, i


def apply_recalled_inside(sects: DataFrame, recalled: DataFrame) -> DataFrame:
    """The same for sections that hold their items (`structure.sections_with_items`): read once, one join."""
    s = sects.join(recalled.select("doc_id", F.col("levels").alias("_levels"), F.col("options").alias("_options")), "doc_id", "left")
    chosen = F.transform("items", lambda x: x.withField("option", F.coalesce(F.get(F.col("_options"), x["h2_ord"] - 1), x["option"])))
    return s.withColumns({"level": F.coalesce(F.get("_levels", F.col("idx")), "level"), "items": chosen}).drop("_levels", "_options")
