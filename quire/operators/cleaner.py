"""Raw word-processor blocks: classification, levels, front matter, boxes and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from .tokens import upto


def doc():
    return Window.partitionBy("doc_id")


def ordered():
    return Window.partitionBy("doc_id").orderBy("i")


def style_levels(styles: DataFrame) -> DataFrame:
    """(doc_id, level, style_id): the style that stands for each heading level.

    styles(doc_id, pos, type, style_id, name, outline): a name "heading N" wins over an
    outline level (tables of contents apart), the first of a kind over later ones.
    """
    name = F.lower(F.coalesce("name", F.lit("")))
    named = F.regexp_extract(name, r"^heading\s*([1-9])$", 1)
    outline = F.when((named == "") & ~name.rlike("^(toc|tdc|índice|indice|contents)"), F.col("outline").try_cast("int") + 1)
    level = F.when(named != "", named.cast("int")).otherwise(outline)
    s = styles.filter("type = 'paragraph'").withColumn("level", level).filter("level between 1 and 4")
    prio = F.when(named != "", 0).otherwise(1)
    return s.groupBy("doc_id", "level").agg(F.min_by("style_id", F.struct(prio, F.col("pos"))).alias("style_id"))


def classify(raw: DataFrame, levels: DataFrame) -> DataFrame:
    """(doc_id, i, kind, role, text): first matching rule of the ladder decides.

    raw(doc_id, i, node, style_id, text, has_image, is_list, anchor, field_code, first_row).
    """
    sid = F.coalesce("style_id", F.lit(""))
    text = T.strip(F.coalesce("text", F.lit("")))
    b = raw.join(levels.select("doc_id", "style_id", "level"), ["doc_id", "style_id"], "left")
    toc_like = (F.coalesce("field_code", F.lit("")).rlike(r"(?i)\bTOC\b") | F.coalesce("anchor", F.lit("")).rlike("(?i)^_Toc")
                | sid.rlike("(?i)^(TDC|TOC)"))
    has_toc = F.max(((F.col("node") == "sdt") | F.coalesce("anchor", F.lit("")).rlike("(?i)^_Toc") | sid.rlike("(?i)^(TDC|TOC)")).cast("int")).over(doc()) == 1
    table_no = F.sum((F.col("node") == "tbl").cast("int")).over(upto(ordered()))
    cells = F.slice(F.filter(F.coalesce("first_row", F.array().cast("array<string>")), lambda c: c != ""), 1, 4)
    box_end = F.regexp_extract(sid, "(" + "|".join(fixed.BOX_STYLE_ENDS) + ")$", 1)
    box = F.try_element_at(F.create_map(*[F.lit(x) for kv in fixed.BOX_STYLE_ENDS.items() for x in kv]), box_end)
    title_like = F.lower(text).isin(fixed.TOC_TITLES)
    img = F.coalesce("has_image", F.lit(False))
    cond = [
        (F.col("node") == "sdt", "toc", F.lit("remove"), F.lit("Índice automático")),
        (F.col("node") == "tbl", "table", F.lit("table:horizontal"),
         F.concat(F.lit("Tabla "), table_no.cast("string"), F.lit(" · "), F.array_join(cells, " / "))),
        (toc_like, "toc", F.lit("remove"), T.blank_to(text, "(entrada de índice)")),
        (has_toc & title_like & (F.col("i") < 15), "cover", F.lit("remove"), text),
        (F.col("level").isNotNull(), "heading", F.concat(F.lit("h"), F.col("level").cast("string")), text),
        (box.isNotNull(), "box", F.concat(F.lit("box:"), box), text),
        (sid.isin(fixed.COVER_STYLES), "cover", F.lit("remove"), T.blank_to(text, "(portada / índice)")),
        ((text == "") & ~img, "empty", F.lit("keep"), F.lit("(línea en blanco)")),
        ((sid == "Prrafodelista") | F.coalesce("is_list", F.lit(False)), "list", F.lit("keep"), T.blank_to(text, "(imagen)")),
    ]
    first = cond[0]
    ladder = F.when(first[0], F.struct(F.lit(first[1]).alias("kind"), first[2].alias("role"), first[3].alias("text")))
    for test, kind, role, shown in cond[1:]:
        ladder = ladder.when(test, F.struct(F.lit(kind).alias("kind"), role.alias("role"), shown.alias("text")))
    ladder = ladder.otherwise(F.struct(F.lit("para").alias("kind"), F.lit("keep").alias("role"), T.blank_to(text, "(imagen)").alias("text")))
    return b.withColumn("_r", ladder).select("doc_id", "i", "_r.kind", "_r.role", "_r.text")


def level_of(role: Column) -> Column:
    return F.regexp_extract(role, "^h([1-4])$", 1).try_cast("int")


def shift_to_top(blocks: DataFrame) -> DataFrame:
    """The highest heading of a document becomes level 1, the others move along."""
    low = F.min(F.when(F.col("kind") == "heading", level_of(F.col("role")))).over(doc())
    b = blocks.withColumn("_low", low)
    moved = F.concat(F.lit("h"), F.greatest(F.lit(1), level_of(F.col("role")) - (F.col("_low") - 1)).cast("string"))
    return b.withColumn("role", F.when((F.col("kind") == "heading") & (F.col("_low") > 1), moved).otherwise(F.col("role"))).drop("_low")


def shift_levels(blocks: DataFrame, delta: int) -> DataFrame:
    lvl = level_of(F.col("role"))
    moved = F.concat(F.lit("h"), F.greatest(F.lit(1), F.least(F.lit(4), lvl + delta)).cast("string"))
    return blocks.withColumn("role", F.when(lvl.isNotNull(), moved).otherwise(F.col("role")))


def front_matter(blocks: DataFrame) -> DataFrame:
    """Everything before the first heading goes; what is no index counts as cover."""
    b = blocks.withColumn("_first", F.min(F.when(F.col("kind") == "heading", F.col("i"))).over(doc()))
    early = F.col("i") < F.col("_first")
    cover = early & (F.col("kind") != "toc")
    dull = F.col("text").isin("", "(imagen)", "(línea en blanco)")
    return (b.withColumn("text", F.when(cover & dull, "(portada)").otherwise(F.col("text")))
            .withColumn("role", F.when(early, "remove").otherwise(F.col("role")))
            .withColumn("kind", F.when(cover, "cover").otherwise(F.col("kind"))).drop("_first"))


def blocks_of(raw: DataFrame, styles: DataFrame) -> DataFrame:
    return front_matter(shift_to_top(classify(raw, style_levels(styles))))


def _with_runs(blocks: DataFrame) -> DataFrame:
    """Adds where the run of neighbours of one role that a block lies in begins, and its first and last block that is more than the box's name."""
    r = Window.partitionBy("doc_id", "role").orderBy("i")
    b = blocks.withColumn("grp", F.col("i") - F.row_number().over(r))
    g = Window.partitionBy("doc_id", "role", "grp")
    label_only = F.col("text").rlike("(?iu)^(ejemplo|importante|definici[oó]n|pie)$")
    b = b.withColumn("kept", ~label_only)
    pos = F.when(F.col("kept"), F.col("i"))
    return (b.withColumn("first", F.min(pos).over(g)).withColumn("last", F.max(pos).over(g))
             .withColumn("anchor", F.min("i").over(g)))


def _row(part: int, text: Column, style: Column | None = None) -> Column:
    return F.struct(F.lit(part).alias("part"), (F.lit(None).cast("string") if style is None else style).alias("style"), text.alias("text"))


def _box_rows() -> Column:
    """What a block of a box becomes: the box's opening marker, the block, the closing marker."""
    text = F.when(F.col("i") == F.col("first"), F.regexp_replace("text", r"^\s*<<\s*", "")).otherwise(F.col("text"))
    text = F.when(F.col("i") == F.col("last"), F.regexp_replace(text, r"\s*>>\s*$", "")).otherwise(text)
    tag = F.concat(F.lit("["), F.substring("role", 5, 100), F.lit("]"))
    opens = (F.col("i") == F.col("first")) | (F.col("first").isNull() & (F.col("i") == F.col("anchor")))
    closes = (F.col("i") == F.col("last")) | (F.col("first").isNull() & (F.col("i") == F.col("anchor")))
    return F.array(F.when(opens, _row(0, tag)), F.when(F.col("kept"), _row(1, text)), F.when(closes, _row(2, F.lit("[fin]"))))


def _rows_of(blocks: DataFrame, rows: Column) -> DataFrame:
    # the outer form keeps the optimizer from computing the arrays a second time in a filter
    out = blocks.select("doc_id", "i", F.inline_outer(F.filter(rows, lambda x: x.isNotNull())))
    return out.filter("part is not null").select("doc_id", "i", "part", "style", "text")


def box_runs(blocks: DataFrame) -> DataFrame:
    """(doc_id, i, part, style, text): neighbouring blocks of one box role become one box.

    Paragraphs that only name the box go, << and >> at its ends too. `part` orders what
    shares a position: 0 opening marker, 1 the block, 2 closing marker.
    """
    return _rows_of(_with_runs(blocks.filter(F.col("role").startswith("box:"))), _box_rows())


def apply_roles(blocks: DataFrame) -> DataFrame:
    """(doc_id, i, part, style, text) of the cleaned document, in (i, part) order. Blocks are read once: each becomes its rows in place."""
    b = _with_runs(blocks.filter("role <> 'remove'"))
    role = F.col("role")
    lvl = level_of(role)
    style = F.when(lvl.isNotNull(), F.concat(F.lit("heading "), lvl.cast("string"))).when(role == "keep", F.col("kind"))
    mark = F.when(role.startswith("table:"), _row(0, F.concat(F.lit("["), F.substring("role", 7, 100), F.lit("]"))))
    return _rows_of(b, F.when(role.startswith("box:"), _box_rows()).otherwise(F.array(mark, _row(1, F.col("text"), style))))


def role_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id").agg(
        F.count_if(F.col("role") == "h1").alias("h1"), F.count_if(F.col("role") == "h2").alias("h2"),
        F.count_if(F.col("role").startswith("box:")).alias("box"), F.count_if(F.col("role") == "remove").alias("removed"))


def visible(blocks: DataFrame, structure_only: bool = True) -> DataFrame:
    if not structure_only:
        return blocks.filter("kind <> 'empty'")
    return blocks.filter(F.col("kind").isin("heading", "box", "table", "cover", "toc") | F.col("role").rlike("^(h[1-4]|box:|table:|remove)"))
