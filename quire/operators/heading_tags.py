"""Structure tags written at the end of headings: parsing, typos and their issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T

SPACE = r"(?:\s|\x{00A0}|&nbsp;|&#160;|&#xa0;)"
TRAILING = rf"(?i)\[([^\[\]]*)\]{SPACE}*\.?{SPACE}*$"
HEADING = r"(?is)<h([1-6])(?:\s[^>]*)?>.*?</h\1>"
FORMS = [(form, key, label, heading, i) for i, (form, key, label, heading) in enumerate(
    (f, k, lb, h) for k, lb, h, _v, fs in fixed.HEADING_TAGS for f in fs)]


def _forms() -> Column:
    return F.array(*[F.struct(F.lit(f).alias("form"), F.lit(k).alias("key"), F.lit(lb).alias("label"),
                              F.lit(h).alias("heading"), F.lit(i).alias("rank")) for f, k, lb, h, i in FORMS])


def find_tag(raw: Column) -> Column:
    """The tag whose accepted forms contain the text, null if none."""
    return T.let(T.normalize_tag(raw), lambda norm: F.get(F.filter(_forms(), lambda f: f["form"] == norm), F.lit(0)))


def near_tag(raw: Column) -> Column:
    """The closest tag within two edits and a third of the form; first on ties."""
    def closest(norm: Column) -> Column:
        scored = F.transform(_forms(), lambda f: F.struct(
            F.levenshtein(norm, f["form"], 2).alias("distance"), f["rank"].alias("rank"),
            f["form"].alias("form"), f["key"].alias("key"), f["label"].alias("label")))
        ok = F.filter(scored, lambda s: (s["distance"] >= 0) & (s["distance"] * 3 <= F.length(s["form"])))
        return F.when((F.length(norm) >= 5) & ~norm.rlike(r"^\d+$"), F.array_min(ok))

    return T.let(T.normalize_tag(raw), closest)


def drop_trailing(inner: Column, raw: Column, count: Column) -> Column:
    """Take `count` characters of text off the end, keeping every tag."""
    kept = F.length(F.regexp_replace(F.substring(raw, F.lit(1), F.length(raw) - count), rf"(?i){SPACE}+$", ""))
    found = F.regexp_extract_all(inner, F.lit(r"<[^>]+>|[^<]+|<"), F.lit(0))
    is_tag = lambda p: p.rlike(r"^<[^>]+>$")

    def cut(v: Column) -> Column:
        def part(p: Column, i: Column) -> Column:
            seen = F.aggregate(F.slice(v["parts"], F.lit(1), i), F.lit(0), lambda a, x: a + F.when(is_tag(x), 0).otherwise(F.length(x)))
            return F.when(is_tag(p), p).otherwise(F.substring(p, F.lit(1), F.greatest(F.lit(0), v["kept"] - seen)))

        return F.array_join(F.transform(v["parts"], part), "")

    return T.let(F.struct(found.alias("parts"), kept.alias("kept")), cut)


def parse_heading(h: Column) -> Column:
    """struct for one heading element: what it becomes and the issue it raises. Every value is computed once a heading."""
    level = F.regexp_extract(h, HEADING, 1)
    open_tag = F.regexp_extract(h, r"(?is)^(<h[1-6](?:\s[^>]*)?>)", 1)

    def outcome(v: Column, x: Column, y: Column) -> Column:
        level, open_tag, tag, near, whole, cleaned, title = v["level"], v["open_tag"], x["tag"], x["near"], x["whole"], x["cleaned"], y
        right = tag["heading"] == level.cast("int")
        close = F.concat(F.lit("</h"), level, F.lit(">"))
        kind = (F.when(whole == "", None)
                .when(tag.isNull(), F.when(near.isNotNull(), "heading-tag-typo"))
                .when(title == "", "heading-tag-only").when(~right, "heading-tag-wrong-level"))
        html = (F.when((whole == "") | tag.isNull() | (title == ""), h)
                .when(right, F.concat(F.substring(open_tag, F.lit(1), F.length(open_tag) - 1),
                                      F.lit(f' {fixed.HEADING_TAG_ATTR}="'), tag["key"], F.lit('">'), cleaned, close))
                .otherwise(F.concat(open_tag, cleaned, close)))
        return F.struct(
            html.alias("html"), kind.alias("kind"), T.plain_text(x["written"]).alias("written"),
            F.coalesce(tag["label"], near["label"]).alias("label"), level.cast("int").alias("heading"),
            F.when(kind == "heading-tag-typo", T.plain_text(v["inner"])).when(kind == "heading-tag-only", "").otherwise(title).alias("context"))

    def tagged(v: Column) -> Column:
        found = F.struct(F.regexp_extract(v["raw"], TRAILING, 0).alias("whole"), F.regexp_extract(v["raw"], TRAILING, 1).alias("written"))
        looked_up = lambda x: F.struct(
            x["whole"].alias("whole"), x["written"].alias("written"), find_tag(x["written"]).alias("tag"), near_tag(x["written"]).alias("near"),
            drop_trailing(v["inner"], v["raw"], F.length(x["whole"])).alias("cleaned"))
        return T.let(T.let(found, looked_up), lambda x: T.let(T.plain_text(x["cleaned"]), lambda y: outcome(v, x, y)))

    def opened(v: Column) -> Column:
        inner = F.substring(h, F.length(v["open_tag"]) + 1, F.length(h) - F.length(v["open_tag"]) - 5)
        return T.let(inner, lambda inner: T.let(F.struct(
            v["level"].alias("level"), v["open_tag"].alias("open_tag"), inner.alias("inner"), F.regexp_replace(inner, r"<[^>]+>", "").alias("raw")), tagged))

    return T.let(F.struct(level.alias("level"), open_tag.alias("open_tag")), opened)


def parse(docs: DataFrame) -> DataFrame:
    """(doc_id, html, issues): tags of the right level become an attribute, the rest of
    the outcomes are issues. Documents without a bracket pass through untouched."""
    hits = F.regexp_extract_all("html", F.lit(HEADING), F.lit(0))
    gaps = F.split("html", HEADING)
    plain = lambda h: F.struct(h.alias("html"), *[F.lit(None).cast(t).alias(n) for n, t in (
        ("kind", "string"), ("written", "string"), ("label", "string"), ("heading", "int"), ("context", "string"))])
    staged = docs.withColumn("_hits", hits).withColumn("_parsed", F.transform(
        "_hits", lambda h: F.when(h.contains("["), parse_heading(h)).otherwise(plain(h))))
    merged = F.array_join(F.flatten(F.zip_with(gaps, F.concat(F.col("_parsed.html"), F.array(F.lit(""))), lambda g, h: F.array(g, h))), "")
    issues = F.filter(F.transform("_parsed", lambda p, i: F.struct(
        i.alias("ord"), p["kind"].alias("kind"), p["written"].alias("written"), p["label"].alias("label"),
        p["heading"].alias("heading"), p["context"].alias("context"))), lambda p: p["kind"].isNotNull())
    return staged.select("doc_id", F.when(F.size("_hits") > 0, merged).otherwise(F.col("html")).alias("html"), issues.alias("issues"))


def tag_value(open_tag: Column, heading: int) -> Column:
    """The level or option a heading's structure attribute stands for."""
    key = T.attr(open_tag, fixed.HEADING_TAG_ATTR)
    pairs = [x for k, _lb, h, v, _f in fixed.HEADING_TAGS if h == heading for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), key)


def first_page_issue(sections: DataFrame) -> DataFrame:
    """The first section tagged as a sub-page; none when a synthetic section precedes it."""
    label = F.when(F.col("word_level") == 2, "Subpágina").otherwise("3er nivel")
    return (sections.filter("idx = 0 and word_level > 1")
            .select("doc_id", F.lit("heading-tag-first-page").alias("kind"), label.alias("written"),
                    label.alias("label"), F.lit(1).alias("heading"), F.col("title").alias("context")))
