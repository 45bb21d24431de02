"""Located issues of author markup.

Detection is one projection per document: the marked-up text is cut at its markers into
an array and neighbours are compared by index, so nothing is shuffled before the issue
rows exist. Only the check for boxes that cannot be formed needs the token table, and it
runs on documents without any other box issue.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..fixed import NBSP_OR_WS, P_OPEN, WS
from ..functions import text as T
from . import markers as M
from . import tokens as K

IU = "(?iu)"
ISSUE = "struct<family:int,ord:int,kind:string,label:string,marker:string,context:string>"
HEADING = r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"


def _issue(family: int, ord_: Column, kind: Column | str, label=None, marker=None, context=None) -> Column:
    s = lambda x: F.lit(None).cast("string") if x is None else (F.lit(x) if isinstance(x, str) else x)
    return F.struct(F.lit(family).alias("family"), ord_.cast("int").alias("ord"), s(kind).alias("kind"),
                    s(label).alias("label"), s(marker).alias("marker"), s(context).alias("context"))


class Cut:
    """The source cut at its markers, as columns of the document table.

    `hits` are the markers, `gaps` the text around them (one more), `pieces` each gap with
    the marker that ends it. They are columns and not inlined expressions because the
    lambdas below read them once per marker.
    """

    def __init__(self, name: str):
        self.name = name

    def col(self, part: str) -> Column:
        return F.col(f"{self.name}_{part}")

    def add(self, docs: DataFrame, pattern: str, src: str = "src") -> DataFrame:
        d = (docs.withColumn(f"{self.name}_hits", F.regexp_extract_all(src, F.lit(pattern), F.lit(0)))
             .withColumn(f"{self.name}_gaps", F.split(src, pattern)))
        ends = F.concat(self.hits, F.array(F.lit("")))
        return d.withColumn(f"{self.name}_pieces", F.zip_with(self.gaps, ends, lambda g, h: F.concat(g, h)))

    hits = property(lambda self: self.col("hits"))
    gaps = property(lambda self: self.col("gaps"))
    pieces = property(lambda self: self.col("pieces"))

    def gap(self, i: Column) -> Column:
        return F.get(self.gaps, i)

    def following(self, i: Column) -> Column:
        """The source after marker i, at least its next 400 characters: a marker is five
        characters or more, so 81 pieces always reach that far. Mostly a few do."""
        piece = lambda n: F.array_join(F.slice(self.pieces, i + 2, F.lit(n)), "")
        return T.let(piece(4), lambda few: F.when(F.length(few) >= 400, few).otherwise(piece(81)))

    def preceding(self, i: Column) -> Column:
        def pieces(n: int) -> Column:
            start = F.greatest(F.lit(1), i - (n - 1))
            return F.concat(F.array_join(F.slice(self.pieces, start, i - start + 1), ""), self.gap(i))
        return T.let(pieces(4), lambda few: F.when(F.length(few) >= 400, few).otherwise(pieces(81)))

    def context(self, i: Column) -> Column:
        return T.context_after(self.following(i))

    def context_or_before(self, i: Column) -> Column:
        return T.let(self.context(i), lambda after: F.when(after != "", after).otherwise(T.context_before(self.preceding(i))))


def _label(marker: Column) -> Column:
    norm = T.strip_diacritics(F.lower(F.regexp_replace(marker, rf"\[{WS}*|{WS}*:?{WS}*\]", "")))
    pretty = F.create_map(*[F.lit(x) for kv in [*fixed.BOX_LABELS.items(), ("fin", "fin")] for x in kv])
    return F.try_element_at(pretty, norm)


def sources(docs: DataFrame) -> DataFrame:
    """(doc_id, src): the text the detectors look at, markers clean and code left out."""
    d = M.normalize_markers(docs.select("doc_id", "html"))
    return d.select("doc_id", T.without_code(F.col("html")).alias("src"))


# Each detector adds what it needs to the document table and returns it with an array of
# issues (null where there is none).

def _box_names(src: DataFrame) -> tuple[DataFrame, Cut]:
    c = Cut("box")
    d = c.add(src, IU + fixed.BOX_MARKER)
    return d.withColumn("box_names", F.transform(c.hits, _label)), c


def box_issues(src: DataFrame) -> tuple[DataFrame, Column]:
    """Unclosed boxes, stray closings and headings inside boxes, in order of detection."""
    d, c = _box_names(src)

    def at(i: Column) -> Column:
        cur, prev = F.get(c.col("names"), i), F.get(c.col("names"), i - 1)
        prev_open = prev.isNotNull() & (prev != "fin")
        return (F.when((cur == "fin") & ~F.coalesce(prev_open, F.lit(False)), _issue(0, i, "stray-fin", context=c.context(i)))
                .when((cur == "fin") & c.gap(i).rlike(HEADING),
                      _issue(0, i, "heading-inside-box", label=prev,
                             context=T.heading_text(F.regexp_extract(c.gap(i), HEADING, 1))))
                .when((cur == "fin"), F.lit(None).cast(ISSUE))
                .when(prev_open, _issue(0, i, "unclosed-box", label=prev, context=c.context(i - 1))))

    return d, F.transform(F.sequence(F.lit(0), F.size(c.hits)), at)


def box_verdict(src: DataFrame) -> DataFrame:
    """(doc_id, src) of documents with opening markers whose box markers alternate
    properly and hold no heading: the ones `box_issues` is silent about."""
    d, c = _box_names(src)
    names = c.col("names")
    fair = F.forall(F.sequence(F.lit(0), F.greatest(F.size(names), F.lit(1)) - 1), lambda i: F.when(
        i % 2 == 0, F.get(names, i) != "fin").otherwise((F.get(names, i) == "fin") & ~c.gap(i).rlike(HEADING)))
    good = (F.size(names) > 0) & (F.size(names) % 2 == 0) & fair
    # a generated column: a plain filter would be pushed below the cuts and repeat them
    return d.select("doc_id", F.explode_outer(F.when(good, F.array("src"))).alias("src")).filter("src is not null")


def leftover_issues(src: DataFrame) -> tuple[DataFrame, Column]:
    """Opening markers still in the text of a document whose boxes have been formed."""
    c = Cut("left")
    return c.add(src, IU + fixed.BOX_OPEN), F.transform(
        c.hits, lambda h, i: _issue(1, i, "box-not-formable", label=_label(h), context=c.context(i)))


def table_marker_issues(src: DataFrame) -> tuple[DataFrame, Column]:
    c = Cut("mark")

    def at(h: Column, i: Column) -> Column:
        ok = c.gap(i).rlike(rf"(?i){P_OPEN}{WS}*$") & c.gap(i + 1).rlike(rf"(?i)^{WS}*</p>{WS}*<table\b")
        word = F.lower(F.regexp_replace(h, rf"\[{WS}*|{WS}*\]", ""))
        return F.when(~ok, _issue(2, i, "table-marker", marker=word, context=c.context(i)))

    return c.add(src, IU + fixed.TABLE_MARKER), F.transform(c.hits, at)


def unmarked_table_issues(src: DataFrame) -> tuple[DataFrame, Column]:
    """Tables without a marker before them and none since the previous table ended."""
    c = Cut("table")
    d = c.add(src, r"(?i)<table\b[^>]*>")
    since = F.transform(c.gaps, lambda g: F.struct(
        g.rlike("(?i)</table>").alias("closed"),
        F.element_at(F.split(g, "(?i)</table>"), -1).rlike(IU + fixed.TABLE_MARKER).alias("marked")))
    # a table inside a table: look on in the text of the enclosing one
    flags = F.aggregate(since, F.array().cast("array<boolean>"), lambda acc, x: F.concat(acc, F.array(
        x["marked"] | (~x["closed"] & F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(False))))))
    d = d.withColumn("table_flags", F.when(F.size(c.hits) > 0, flags))

    def at(h: Column, i: Column) -> Column:
        marked = c.gap(i).rlike(rf"{IU}{P_OPEN}{WS}*{fixed.TABLE_MARKER}{WS}*</p>{WS}*$")
        return F.when(~marked & ~F.get(c.col("flags"), i) & (F.size(c.col("flags")) > 0),
                      _issue(3, i, "table-without-marker", context=c.context(i)))

    return d, F.transform(c.hits, at)


def group_end_issues(src: DataFrame) -> tuple[DataFrame, Column]:
    c = Cut("end")

    def at(h: Column, i: Column) -> Column:
        alone = c.gap(i).rlike(rf"(?i){P_OPEN}{WS}*$") & c.gap(i + 1).rlike(rf"(?i)^{WS}*</p>")
        return F.when(~alone, _issue(4, i, "accordion-marker", marker="fin acordeón", context=c.context_or_before(i)))

    return c.add(src, IU + fixed.GROUP_END), F.transform(c.hits, at)


def resource_issues(src: DataFrame) -> tuple[DataFrame, Column]:
    c = Cut("res")
    d = M.split_resource_breaks(src.withColumn("res_src", F.col("src")), "res_src")

    def at(h: Column, i: Column) -> Column:
        after = c.gap(i + 1)
        opens = c.gap(i).rlike(rf"(?i)<(?:p|li)\b[^>]*>{NBSP_OR_WS}*$")
        # nothing after the marker: the line or the document ends here
        ends = after.rlike(rf"(?i)^{NBSP_OR_WS}*</(?:p|li)>") | (
            (i == F.size(c.hits) - 1) & after.rlike(rf"(?i)^{NBSP_OR_WS}*$"))
        word = F.lower(F.regexp_replace(h, rf"\[{WS}*|{WS}*:{WS}*\]", ""))
        name = F.when(T.strip_diacritics(word) == "video", "vídeo").otherwise(word)
        return F.when(~opens | ends, _issue(5, i, "resource-marker", marker=name, context=c.context_or_before(i)))

    return c.add(d, IU + fixed.RESOURCE_MARKER, "res_src"), F.transform(c.hits, at)


ROW_DETECTORS = {
    "box": box_issues, "table": table_marker_issues, "unmarked": unmarked_table_issues,
    "group-end": group_end_issues, "resource": resource_issues,
}
FAMILIES = ["box", "unformable", "table", "unmarked", "group-end", "resource"]


def row_issues(src: DataFrame, detectors: list) -> DataFrame:
    """Run detectors in one pass over the rows, without a shuffle."""
    found = []
    d = src
    for detect_one in detectors:
        d, arr = detect_one(d)
        found.append(F.filter(arr, lambda x: x.isNotNull()))
    # the outer form keeps the optimizer from computing the arrays a second time in a filter
    return d.select("doc_id", F.inline_outer(F.concat(*found))).filter("kind is not null")


def unformable_boxes(src: DataFrame, placed: bool = False) -> DataFrame:
    """Boxes left over after forming, in documents with no other box issue."""
    fair = box_verdict(src).select("doc_id", F.col("src").alias("html"))
    left = K.untokenize(M.form_boxes(K.tokens(fair, placed)))
    return row_issues(left.select("doc_id", F.col("html").alias("src")), [leftover_issues])


def detect(docs: DataFrame, families: list[str] = FAMILIES, placed: bool = False) -> DataFrame:
    """Marker issues: (doc_id, family, ord, kind, label, marker, context).

    One pass over the rows finds everything but boxes that cannot be formed; those take a
    second one that shuffles only the documents without any other box issue.
    """
    src = sources(docs)
    rows = [ROW_DETECTORS[f] for f in families if f in ROW_DETECTORS]
    parts = ([row_issues(src, rows)] if rows else []) + ([unformable_boxes(src, placed)] if "unformable" in families else [])
    return reduce(DataFrame.unionByName, parts)


def heading_issue_rows(parsed: DataFrame) -> DataFrame:
    """Heading-tag issues in the shape of `detect`, from `heading_tags.parse`."""
    return parsed.select("doc_id", F.inline_outer("issues")).filter("kind is not null").select(
        "doc_id", F.lit(6).alias("family"), "ord", "kind", "label",
        F.col("written").alias("marker"), "context")


def union_all(marker_issues: DataFrame, heading_issues: DataFrame) -> DataFrame:
    """One table in report order: (family, ord) within a document."""
    return marker_issues.unionByName(heading_issues)


def has_issues(docs: DataFrame, issues: DataFrame) -> DataFrame:
    n = issues.groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.col("n").isNotNull().alias("has_issues"))


def describe(issues: DataFrame) -> DataFrame:
    """Adds `message`: the text shown to the author, from the template table."""
    templates = F.create_map(*[F.lit(x) for kv in fixed.ISSUE_MESSAGES.items() for x in kv])
    ctx = F.coalesce("context", F.lit(""))
    near = F.when(ctx != "", F.concat(F.lit(" (cerca de «"), ctx, F.lit("»)"))).otherwise("")
    near_text = F.when(ctx != "", F.concat(F.lit(" (cerca del texto «"), ctx, F.lit("»)"))).otherwise("")
    slots = {"%1$s": F.coalesce("label", F.lit("")), "%2$s": F.coalesce("marker", F.lit("")),
             "%3$s": near, "%5$s": near_text, "%4$s": ctx}
    msg = F.try_element_at(templates, F.col("kind"))
    for slot, value in slots.items():
        msg = F.replace(msg, F.lit(slot), value)
    return issues.withColumn("message", msg)


def describe_headings(issues: DataFrame) -> DataFrame:
    """`message` for heading-tag issues with columns kind, written, label, heading, context."""
    templates = F.create_map(*[F.lit(x) for kv in fixed.HEADING_MESSAGES.items() for x in kv])
    ctx, lvl = F.coalesce("context", F.lit("")), F.col("heading").cast("int")
    name = F.concat(F.lit("Título "), lvl.cast("string"))
    quoted = F.concat(F.lit("título «"), ctx, F.lit("»"))
    place = F.when(ctx == "", "").otherwise(
        F.when(F.col("kind") == "heading-tag-typo", F.concat(F.lit(", en el "), quoted, F.lit(",")))
        .when(F.col("kind") == "heading-tag-wrong-level", F.concat(F.lit(" al "), quoted))
        .otherwise(F.concat(F.lit(" del "), quoted)))
    valid = F.when(lvl == 1, fixed.HEADING_VALID[1]).when(lvl == 2, fixed.HEADING_VALID[2]).otherwise(fixed.HEADING_VALID[0])
    msg = F.try_element_at(templates, F.col("kind"))
    for slot, value in {"%5$s": valid, "%3$s": name, "%1$s": F.coalesce("written", F.lit("")),
                        "%2$s": F.col("label"), "%4$s": place}.items():
        msg = F.replace(msg, F.lit(slot), value)
    return issues.withColumn("message", msg)


# --- structure rules ----------------------------------------------------------------

def structure_rules(sections: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, rule, h1_ord, h2_ord): level jumps, and title items that are not last."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    prev = F.coalesce(F.lag("level").over(w), F.lit(0))
    jumps = (sections.withColumn("_prev", prev).filter((F.col("level") == 3) & ~F.col("_prev").isin(2, 3))
             .select("doc_id", F.lit(fixed.RULE_LEVEL).alias("rule"), "h1_ord", F.lit(None).cast("int").alias("h2_ord")))
    v = Window.partitionBy("doc_id", "h1_ord").orderBy("h2_ord")
    late = (items.withColumn("_next", F.lead("option").over(v))
            .filter((F.col("option") == "idevice-title") & (F.col("_next") != "idevice-title"))
            .select("doc_id", F.lit(fixed.RULE_TITLE).alias("rule"), "h1_ord", "h2_ord"))
    return jumps.unionByName(late)


def section_error_counts(sections: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, h1_ord, item_errors, any_error) per section."""
    n = rules.groupBy("doc_id", "h1_ord").agg(
        F.count_if(F.col("h2_ord").isNotNull()).alias("item_errors"), F.count("*").alias("_n"))
    return (sections.select("doc_id", "h1_ord").join(n, ["doc_id", "h1_ord"], "left")
            .select("doc_id", "h1_ord", F.coalesce("item_errors", F.lit(0)).alias("item_errors"),
                    F.col("_n").isNotNull().alias("any_error")))


def theme_required_files(files: DataFrame, nested: bool = False) -> DataFrame:
    """(theme_id, missing): required files a theme lacks at its root (or, for publishing,
    anywhere below)."""
    need = files.select("theme_id").distinct().select(
        "theme_id", F.explode(F.array(*[F.lit(f) for f in fixed.REQUIRED_THEME_FILES])).alias("missing"))
    name = F.element_at(F.split("path", "/"), -1) if nested else F.col("path")
    have = files.select("theme_id", name.alias("missing")).distinct()
    return need.join(have, ["theme_id", "missing"], "left_anti")
