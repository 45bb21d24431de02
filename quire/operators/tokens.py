"""Token table and element table of HTML documents.

A document is one row, so the row is what gets shuffled: `by_doc` places it by
`doc_id` before it is exploded. The explode keeps that placement, and every window and
aggregate of a document keyed by `doc_id` then runs without a further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T

TOKEN = r"<[^>]+>|\[[^\[\]<>]*\]|[^<\[]+|[<\[]"


def doc_window():
    return Window.partitionBy("doc_id").orderBy("pos")


def upto(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def by_doc(docs: DataFrame, placed: bool = False) -> DataFrame:
    """Place documents by `doc_id`, unless they are (a bucketed table, an earlier call)."""
    return docs if placed else docs.repartition("doc_id")


def clean_markup(html: Column) -> Column:
    """Drop comments, the head, the document's own tags and the raw text of script and
    style elements. One look tells whether there are any."""
    c = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?is)<head\b[^>]*>.*?</head>", "")
    c = F.regexp_replace(c, r"(?is)(<script\b[^>]*>).*?(</script>)", "$1$2")
    c = F.regexp_replace(c, r"(?is)(<style\b[^>]*>).*?(</style>)", "$1$2")
    c = F.regexp_replace(c, r"(?i)</?(?:html|body|!doctype)\b[^>]*>", "")
    return F.when(html.rlike(r"(?i)<(?:!--|/?(?:head|script|style|html|body|!doctype)\b)"), c).otherwise(html)


def classify(tok: Column) -> tuple[Column, Column]:
    """(kind, tag) of a token: open, close, void, bracket or text."""
    raw = F.when(tok.startswith("<"), F.regexp_extract(tok, r"^</?([a-zA-Z!][a-zA-Z0-9:!-]*)", 1)).otherwise("")
    tag = F.when(raw.rlike("[A-Z]"), F.lower(raw)).otherwise(raw)
    kind = (F.when(raw == "", F.when(tok.startswith("[") & tok.rlike(r"^\[.*\]$"), "bracket").otherwise("text"))
            .when(tok.startswith("</"), "close")
            .when(tag.isin(fixed.VOID_TAGS) | tok.endswith("/>"), "void")
            .otherwise("open"))
    return kind, F.when(raw != "", tag)


def tokens(docs: DataFrame, placed: bool = False, own: Column | None = None) -> DataFrame:
    """(doc_id, pos, tok, kind, tag): one row per tag, bracket group or text run.

    `own` adds a row of the document itself, at pos -1, of kind `own` and with that text:
    documents without any token then stay in the flow, and need no join to come back.
    """
    base = by_doc(docs, placed)
    toks = F.regexp_extract_all(clean_markup(F.col("html")), F.lit(TOKEN), F.lit(0))
    if own is not None:
        toks = F.concat(F.array(own.cast("string")), F.coalesce(toks, F.array().cast("array<string>")))
    # the outer form: the plain one makes the optimizer filter on the array's size below the
    # generator, which computes the array twice
    out = base.select("doc_id", F.posexplode_outer(toks).alias("pos", "tok"))
    kind, tag = classify(F.col("tok"))
    if own is None:
        return out.filter("tok is not null").select("doc_id", "pos", "tok", kind.alias("kind"), tag.alias("tag"))
    first = F.col("pos") == 0
    return out.select("doc_id", (F.col("pos") - 1).alias("pos"), "tok", F.when(first, "own").otherwise(kind).alias("kind"), F.when(~first, tag).alias("tag"))


def with_code(toks: DataFrame) -> DataFrame:
    """Flag tokens inside (or bounding) pre and code elements."""
    code = F.col("tag").isin("pre", "code")
    delta = F.when(code & (F.col("kind") == "open"), 1).when(code & (F.col("kind") == "close"), -1).otherwise(0)
    run = F.sum(delta).over(upto(doc_window()))
    return toks.withColumn("in_code", (run > 0) | F.coalesce(code, F.lit(False)))


def untokenize(toks: DataFrame, col: str = "tok") -> DataFrame:
    return toks.groupBy("doc_id").agg(F.expr(f"listagg({col}, '') within group (order by pos)").alias("html"))


def with_depth(toks: DataFrame) -> DataFrame:
    """Container depth before each token and the ordinal of its top-level block.

    Depth counts only elements that always carry an end tag. A paragraph ends at the
    next block instead of nesting, which is how browsers read unclosed ones, and stray
    end tags cannot push the depth below zero.
    """
    w = doc_window()
    cont = F.col("tag").isin(fixed.CONTAINER_TAGS)
    is_open, is_close = F.col("kind") == "open", F.col("kind") == "close"
    t = toks.withColumn("_d", F.when(cont & is_open, 1).when(cont & is_close, -1).otherwise(0))
    t = t.withColumn("_s", F.sum("_d").over(upto(w)))
    t = t.withColumn("depth", F.col("_s") - F.col("_d") - F.least(F.lit(0), F.min("_s").over(before(w))))
    top = F.col("depth") == 0
    is_p = F.col("tag") == "p"
    event = F.when(top & is_p & is_open, 1).when(top & is_p & is_close, 0).when(top & cont & is_open, 0)
    t = t.withColumn("_p", event)
    t = t.withColumn("in_p", F.coalesce(F.last("_p", ignorenulls=True).over(before(w)), F.lit(0)))
    alone = F.col("tag").isin("img", "hr", "embed") & (F.col("in_p") == 0)
    starts = F.coalesce(top & ((is_open & (cont | is_p)) | alone), F.lit(False))
    t = t.withColumn("starts", starts)
    t = t.withColumn("block", F.sum(starts.cast("int")).over(upto(w)) - 1)
    inside = F.col("starts") | (F.col("depth") > 0) | (F.col("in_p") == 1)
    return t.withColumn("inside", inside).drop("_d", "_s", "_p")


def elements_of(toks: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """Top-level blocks of a token table; `extra` maps output names to token columns
    whose values are joined beside `html`."""
    t = with_depth(toks).filter("inside and block >= 0 or kind = 'own'")
    joined = [F.expr(f"listagg({c}, '') within group (order by pos)").alias(n) for n, c in (extra or {}).items()]
    e = (t.groupBy("doc_id", "block")
         .agg(F.min_by("tag", "pos").alias("tag"), F.min_by("tok", "pos").alias("open_tag"),
              F.expr("listagg(tok, '') within group (order by pos)").alias("html"), *joined))
    level = F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int"))
    e = e.withColumn("html", F.when(F.col("block") < 0, "").otherwise(F.col("html")))
    return e.select("doc_id", F.col("block").cast("int").alias("pos"), "tag", level.alias("level"),
                    T.plain_text(F.col("html")).alias("text"), "html", "open_tag", *(extra or {}))


def elements(docs: DataFrame, placed: bool = False, own: Column | None = None) -> DataFrame:
    """(doc_id, pos, tag, level, text, html, open_tag): top-level blocks in order; with `own` an
    element of the document itself before them (pos -1, no tag, `own` as its open_tag)."""
    return elements_of(tokens(docs, placed, own))


def own_elements(docs: DataFrame, own: Column) -> DataFrame:
    """The elements of the documents themselves, for elements that were made without."""
    none = F.lit("")
    return docs.select("doc_id", F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("tag"), F.lit(None).cast("int").alias("level"),
                       none.alias("text"), none.alias("html"), own.cast("string").alias("open_tag"))
