"""Author markers: normalisation and the ordered passes that act on them.

Row passes rewrite the `html` column of a document table inside its row, with no shuffle.
Token passes rewrite `tok` in a token table that is already placed by document; tokens
that disappear become empty and are filtered. Both map a DataFrame to a DataFrame. All token
passes together walk each document's tokens within its row instead (`fold`): what changes in one
of them changes in the other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..fixed import ANY_MARKER, BR, LINE_MARKER, NBSP_OR_WS, P_OPEN, RESOURCE_MARKER, WS
from ..functions import images as I
from ..functions import text as T
from . import fold
from . import tokens as K

IU = "(?iu)"
_CUT, _LONE = "\uE030", "\uE031"  # private-use marks, removed again below


def sub(c: Column, pattern: str, repl: str) -> Column:
    return F.regexp_replace(c, pattern, repl)


def rewrite_matches(html: Column, pattern: str, fn) -> Column:
    """Replace every match of `pattern` by `fn(match)` within the row."""
    hits = F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    gaps = F.split(html, pattern)
    padded = F.concat(F.transform(hits, fn), F.array(F.lit("")))
    return F.array_join(F.flatten(F.zip_with(gaps, padded, lambda g, h: F.array(g, h))), "")


def rewrite(docs: DataFrame, pattern: str, fn, col: str = "html") -> DataFrame:
    """`rewrite_matches` on a column, skipped for rows without a match.

    The hits are a column of their own and read twice, so the optimizer keeps them as one
    evaluation per row instead of folding them into the lambda.
    """
    d = docs.withColumn("_hits", F.regexp_extract_all(col, F.lit(pattern), F.lit(0)))
    padded = F.concat(F.transform("_hits", fn), F.array(F.lit("")))
    merged = F.array_join(F.flatten(F.zip_with(F.split(col, pattern), padded, lambda g, h: F.array(g, h))), "")
    return d.withColumn(col, F.when(F.size("_hits") > 0, merged).otherwise(F.col(col))).drop("_hits")


# --- row passes -------------------------------------------------------------------

def normalize_markers(docs: DataFrame, col: str = "html") -> DataFrame:
    """Bring every marker to a clean bracket, line markers to a paragraph of their own."""
    def bracket(b: Column) -> Column:
        no_anchor = sub(b, rf"(?i)<a[^>]*>{WS}*</a>", "")
        bare = sub(no_anchor, "<[^>]*>", "")
        return F.when(~b.contains("<"), b).when(bare.rlike(rf"{IU}^{ANY_MARKER}$"), bare).otherwise(no_anchor)

    d = rewrite(docs, r"\[[^\]]*\]", bracket, col)
    # as many rounds as formatting tags are nested before any one bracket
    runs = F.regexp_extract_all(col, F.lit(rf"(?i)((?:<(?:{fixed.FORMAT_TAGS})\b[^>]*>\s*)+)\["), F.lit(1))
    d = d.withColumn("_rounds", F.coalesce(F.array_max(F.transform(runs, lambda r: F.size(F.split(r, "<")) - 1)), F.lit(0)))
    wrapped = rf"{IU}<({fixed.FORMAT_TAGS})\b[^>]*>{WS}*({ANY_MARKER}){WS}*</\1>"
    out = F.when(F.col("_rounds") == 0, F.col(col)).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("_rounds"), F.lit(1))), F.col(col), lambda acc, _i: sub(acc, wrapped, "$2")))

    out = sub(out, rf"{IU}({ANY_MARKER}){WS}*(?:{BR}{WS}*)+", "$1")
    out = sub(out, rf"{IU}(?:{BR}{WS}*)+({LINE_MARKER})", "$1")
    # leading marker to its own paragraph, then the same for a trailing one
    out = sub(out, rf"{IU}({P_OPEN}){WS}*({LINE_MARKER}){WS}*+(?!</p>)", rf"<p>$2</p>{_CUT}$1")
    # a marker alone in its paragraph is held back from the second step, however long the paragraph's tag is
    out = sub(out, rf"{IU}({P_OPEN}{WS}*)(?={LINE_MARKER}{WS}*</p>)", f"$1{_LONE}")
    out = sub(out, rf"{IU}(?={WS}*\[)(?<!{WS})(?<!{_LONE}){WS}*({LINE_MARKER}){WS}*</p>", "</p><p>$1</p>")
    out = sub(out, _LONE, "")
    out = sub(out, rf"{IU}{_CUT}{P_OPEN}{WS}*({LINE_MARKER}){WS}*</p>", "<p>$1</p>")
    out = sub(out, _CUT, "")
    return d.withColumn(col, F.when(F.col(col).contains("["), out).otherwise(F.col(col))).drop("_rounds")


def embed_iframes(docs: DataFrame, prefix: str = fixed.CLASS_PREFIX) -> DataFrame:
    """Escaped iframes to real ones inside a wrapper, alone or as a whole paragraph."""
    frame = r"&lt;iframe\b.*?&lt;/iframe&gt;"

    def real(m: Column) -> Column:
        esc = F.regexp_extract(m, rf"(?is)({frame})", 1)
        body = F.regexp_replace(T.unescape_basic(esc), r"(?i)^<iframe\b",
                                '<iframe style="display: block; margin: 1em auto; max-width: 100%;"')
        return F.concat(F.lit(f'<div class="{prefix}video">'), body, F.lit("</div>"))

    return rewrite(docs, rf"(?is){P_OPEN}\s*{frame}\s*</p>|{frame}", real)


RESOURCE_LEADING = (rf"{IU}^{NBSP_OR_WS}*\[{NBSP_OR_WS}*({fixed.RESOURCE_WORDS}){NBSP_OR_WS}*:"
                    rf"{NBSP_OR_WS}*\]{NBSP_OR_WS}*")


def split_resource_breaks(docs: DataFrame, col: str = "html") -> DataFrame:
    """A paragraph with resource markers after line breaks becomes one per marker line."""
    def para(p: Column) -> Column:
        start = F.regexp_extract(p, rf"(?i)^({P_OPEN})", 1)
        inner = F.substring(p, F.length(start) + 1, F.length(p) - F.length(start) - 4)
        lines = F.transform(F.split(inner, rf"(?i){BR}"), lambda s, i: (
            F.when(i == 0, s).when(s.rlike(RESOURCE_LEADING), F.concat(F.lit("</p>"), start, s))
            .otherwise(F.concat(F.lit("<br />"), s))))
        split = F.concat(start, F.array_join(lines, ""), F.lit("</p>"))
        return F.when(p.rlike(rf"{IU}{BR}{NBSP_OR_WS}*{RESOURCE_MARKER}"),
                      sub(split, rf"(?i){P_OPEN}{WS}*</p>", "")).otherwise(p)

    return rewrite(docs, rf"(?is){P_OPEN}.*?</p>", para, col)


# --- token passes -------------------------------------------------------------------

def _keep(toks: DataFrame) -> DataFrame:
    return toks.filter("tok <> ''")


def _neighbours(toks: DataFrame) -> DataFrame:
    """Nearest non-blank tokens on both sides: p1, p2 before and n1..n3 after."""
    w = K.doc_window()
    t = toks.withColumn("_sig", F.when(F.col("tok").rlike(rf"^{WS}*$"), None).otherwise(
        F.when(F.col("tag") == "p", F.when(F.col("kind") == "open", "p").otherwise("/p")).otherwise(F.col("tok"))))
    for name, fn, k in (("p1", F.lag, 1), ("p2", F.lag, 2), ("n1", F.lead, 1), ("n2", F.lead, 2)):
        f = "lag" if fn is F.lag else "lead"
        t = t.withColumn(name, F.expr(f"{f}(_sig, {k}) ignore nulls over (partition by doc_id order by pos)"))
    return t.drop("_sig")


def _live_marker(pattern: str) -> Column:
    return (F.col("kind") == "bracket") & F.col("tok").rlike(rf"{IU}^{pattern}$") & ~F.col("in_code")


def form_boxes(toks: DataFrame, prefix: str = fixed.CLASS_PREFIX) -> DataFrame:
    """Open marker, content and [fin] become a box.

    Paragraph markers: between two boundaries (a heading or a closed box) the first
    opening takes everything up to the [fin] that ends the stretch. Inline markers: the
    same, with every block tag as a boundary too, over what is left.
    """
    w = K.doc_window()
    t = _neighbours(K.with_code(toks))
    alone = (F.col("p1") == "p") & (F.col("n1") == "/p")
    heading = F.col("tag").rlike("^h[1-6]$") & (F.col("kind") == "open") & ~F.col("in_code")
    fin = _live_marker(r"\[fin\]")
    opening = _live_marker(fixed.BOX_OPEN)

    def pair(t: DataFrame, ok: Column, wall: Column, name: str) -> DataFrame:
        ends, opens = F.coalesce(ok & fin, F.lit(False)), F.coalesce(ok & opening, F.lit(False))
        t = t.withColumn("_edge", (ends | F.coalesce(wall, F.lit(False))).cast("int"))
        t = t.withColumn("_seg", F.sum("_edge").over(K.upto(w)) - F.col("_edge"))
        s = Window.partitionBy("doc_id", "_seg").orderBy("pos")
        whole = s.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        t = t.withColumn("_first", F.min(F.when(opens, F.col("pos"))).over(whole))
        t = t.withColumn("_fin", F.max(F.when(ends, F.col("pos"))).over(whole))
        formed = F.col("_first").isNotNull() & (F.col("_fin") > F.col("_first"))
        label = T.strip_diacritics(F.lower(sub(F.col("tok"), rf"\[{WS}*|{WS}*\]", "")))
        return (t.withColumn(name, F.when(formed & (F.col("pos") == F.col("_first")), label)
                             .when(formed & (F.col("pos") == F.col("_fin")), "/"))
                .drop("_edge", "_seg", "_first", "_fin"))

    t = pair(t, alone, heading, "_box")
    boundary = F.col("tok").rlike(rf"(?i)^{fixed.BLOCK_BOUNDARY}") & ~F.col("in_code")
    # a formed paragraph box is a block boundary for the inline ones
    t = pair(t, F.col("_box").isNull(), boundary | F.col("_box").isNotNull(), "_inline")
    # the paragraph tags around a formed marker go with it
    eaten = ((F.col("tag") == "p") & (
        ((F.col("kind") == "open") & F.expr("lead(_box) over (partition by doc_id order by pos)").isNotNull())
        | ((F.col("kind") == "close") & F.lag("_box").over(w).isNotNull())))
    mark = F.coalesce("_box", "_inline")
    new = (F.when(mark == "/", "</div>").when(mark.isNotNull(), F.concat(F.lit(f'<div class="{prefix}'), mark, F.lit('">')))
           .when(eaten, "").otherwise(F.col("tok")))
    kind = F.when(mark == "/", "close").when(mark.isNotNull(), "open").otherwise(F.col("kind"))
    return _keep(t.select("doc_id", "pos", new.alias("tok"), kind.alias("kind"),
                          F.when(mark.isNotNull(), "div").otherwise(F.col("tag")).alias("tag")))


def add_class(tag_tok: Column, cls: Column) -> Column:
    has = tag_tok.rlike(r"""(?i)\sclass=["'][^"']*["']""")
    return (F.when(has, F.regexp_replace(tag_tok, F.lit(r"""(?i)(\sclass=)["']([^"']*)["']"""),
                                         F.concat(F.lit('$1"$2 '), cls, F.lit('"'))))
            .otherwise(F.concat(F.regexp_extract(tag_tok, r"(?s)^(.*?)\s*/?>$", 1), F.lit(' class="'), cls,
                                F.when(tag_tok.endswith("/>"), '" />').otherwise('">'))))


def orient_tables(toks: DataFrame, prefix: str = fixed.CLASS_PREFIX) -> DataFrame:
    """A paragraph holding only an orientation marker right before a table becomes the
    table's class."""
    w = K.doc_window()
    t = _neighbours(toks)
    is_table = (F.col("kind") == "open") & (F.col("tag") == "table")
    marker = F.lower(F.regexp_extract(F.col("tok"), rf"{IU}^\[{WS}*({fixed.TABLE_WORDS}){WS}*\]$", 1))
    used = ((F.col("kind") == "bracket") & (marker != "") & (F.col("p1") == "p") & (F.col("n1") == "/p")
            & F.col("n2").rlike(r"(?i)^<table\b"))
    t = t.withColumn("_m", F.when(used, marker))
    # the last used marker is this table's when only its closing paragraph lies between
    last = F.last("_m", ignorenulls=True).over(K.before(w))
    seen = F.last(F.when(F.col("_m").isNotNull() | is_table, F.col("_m").isNotNull()), ignorenulls=True).over(K.before(w))
    t = t.withColumn("_orient", F.when(is_table & (F.col("p1") == "/p")
                                       & F.col("p2").rlike(rf"{IU}^{fixed.TABLE_MARKER}$") & seen, last))
    eaten = F.col("_m").isNotNull() | ((F.col("tag") == "p") & (
        ((F.col("kind") == "open") & F.lead("_m").over(w).isNotNull())
        | ((F.col("kind") == "close") & F.lag("_m").over(w).isNotNull())))
    new = (F.when(eaten, "").when(F.col("_orient").isNotNull(),
                                  add_class(F.col("tok"), F.concat(F.lit(prefix + "tabla_"), F.col("_orient"))))
           .otherwise(F.col("tok")))
    return _keep(t.select("doc_id", "pos", new.alias("tok"), "kind", "tag"))


def table_cells(toks: DataFrame, prefix: str = fixed.CLASS_PREFIX) -> DataFrame:
    """Adds to every token its table, row, cell and orientation (nested tables apart)."""
    w = K.doc_window()
    is_open = F.col("kind") == "open"
    step = (F.when((F.col("tag") == "table") & is_open, 1)
            .when((F.col("tag") == "table") & (F.col("kind") == "close"), -1).otherwise(0))
    t = toks.withColumn("_s", F.coalesce(step, F.lit(0)))
    t = t.withColumn("tdepth", F.sum("_s").over(K.upto(w)) + F.when(F.col("_s") == -1, 1).otherwise(0))
    # tables of one depth never overlap, so the running count per depth names the table
    d = Window.partitionBy("doc_id", "tdepth").orderBy("pos")
    opens_table = (F.col("tag") == "table") & is_open
    t = t.withColumn("table_id", F.last(F.when(opens_table, F.col("pos")), ignorenulls=True).over(K.upto(d)))
    orient = F.when(opens_table, F.when(F.col("tok").rlike(rf"\b{prefix}tabla_vertical\b"), "vertical").otherwise("horizontal"))
    t = t.withColumn("orient", F.last(orient, ignorenulls=True).over(K.upto(d)))
    r = Window.partitionBy("doc_id", "tdepth", "table_id").orderBy("pos")
    t = t.withColumn("row", F.sum(((F.col("tag") == "tr") & is_open).cast("int")).over(K.upto(r)) - 1)
    c = Window.partitionBy("doc_id", "tdepth", "table_id", "row").orderBy("pos")
    cell = F.col("tag").isin("td", "th") & is_open
    t = t.withColumn("col", F.sum(cell.cast("int")).over(K.upto(c)) - 1)
    return t.drop("_s")


def structure_tables(toks: DataFrame, prefix: str = fixed.CLASS_PREFIX) -> DataFrame:
    """One header line per table, by orientation: first row or first column."""
    t = table_cells(toks, prefix)
    in_table = F.col("tdepth") > 0
    head = F.when(F.col("orient") == "horizontal", F.col("row") == 0).otherwise(F.col("col") == 0)
    cell = in_table & F.col("tag").isin("td", "th")
    want = F.when(head, "th").otherwise("td")
    attrs = F.concat(*[F.when(T.attr(F.col("tok"), a).isNotNull() & (T.attr(F.col("tok"), a) != ""),
                              F.concat(F.lit(f' {a}="'), T.attr(F.col("tok"), a), F.lit('"'))).otherwise("")
                       for a in ("colspan", "rowspan")])
    scope = F.when(head, F.when(F.col("orient") == "horizontal", ' scope="col"').otherwise(' scope="row"')).otherwise("")
    # a cell of the right kind keeps its attributes; only its scope is set or dropped
    unscoped = F.regexp_replace("tok", r"""(?i)\sscope=("[^"]*"|'[^']*'|[^\s>]+)""", "")
    scoped = F.concat(F.regexp_extract(unscoped, r"(?s)^(.*?)>$", 1), scope, F.lit(">"))
    open_cell = F.when(F.col("tag") == want, scoped).otherwise(F.concat(F.lit("<"), want, attrs, scope, F.lit(">")))
    row_tag = in_table & (F.col("tag") == "tr")
    horizontal, is_open = F.col("orient") == "horizontal", F.col("kind") == "open"
    w = Window.partitionBy("doc_id", "tdepth", "table_id").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("_rows", F.max("row").over(w))
    first, last = F.col("row") == 0, F.col("row") == F.col("_rows")
    row_open = F.concat(F.when(first & horizontal, "<thead>").when((F.col("row") == F.when(horizontal, 1).otherwise(0)), "<tbody>").otherwise(""), F.col("tok"))
    row_close = F.concat(F.col("tok"), F.when(first & horizontal, "</thead>").when(last, "</tbody>").otherwise(""))
    unmarked = in_table & (F.col("tag") == "table") & is_open & ~F.col("tok").rlike(rf"\b{prefix}tabla_(horizontal|vertical)\b")
    new = (F.when(in_table & F.col("tag").isin("thead", "tbody", "tfoot"), "")
           .when(cell & is_open, open_cell)
           .when(cell & (F.col("kind") == "close"), F.concat(F.lit("</"), want, F.lit(">")))
           .when(row_tag & is_open, row_open).when(row_tag, row_close)
           .when(unmarked, add_class(F.col("tok"), F.lit(prefix + "tabla_horizontal")))
           .otherwise(F.col("tok")))
    out = t.select("doc_id", "pos", F.coalesce(new, F.col("tok")).alias("tok"), "kind",
                   F.when(F.coalesce(cell, F.lit(False)), want).otherwise(F.col("tag")).alias("tag"))
    return _keep(out)


def split_resource_lines(toks: DataFrame) -> DataFrame:
    """`split_resource_breaks` on tokens, for use after boxes and tables are formed: a line break
    before a resource marker ends its paragraph and opens the same one again."""
    w = K.doc_window()
    p_open, p_close = (F.col("tag") == "p") & (F.col("kind") == "open"), (F.col("tag") == "p") & (F.col("kind") == "close")
    t = _neighbours(toks)
    t = t.withColumn("_p", F.last(F.when(p_open, F.col("tok")).when(p_close, ""), ignorenulls=True).over(K.upto(w)))
    t = t.withColumn("_t", F.when(~F.col("tok").rlike(rf"^{NBSP_OR_WS}*$"), F.col("tok")))
    marker = F.expr("lead(_t) ignore nulls over (partition by doc_id order by pos)").rlike(RESOURCE_LEADING)
    t = t.withColumn("_cut", F.coalesce((F.col("tag") == "br") & (F.col("_p") != "") & marker, F.lit(False)))
    t = t.withColumn("_c", F.when(~F.col("tok").rlike(rf"^{WS}*$"), F.col("_cut")))
    cut_next = F.expr("lead(_c) ignore nulls over (partition by doc_id order by pos)")
    parts = (F.when(F.col("_cut") & (F.col("p1") == "p"), F.array("_p")).when(F.col("_cut"), F.array(F.lit("</p>"), F.col("_p")))
             .when(p_open & cut_next, F.array().cast("array<string>")).otherwise(F.array("tok")))
    return _resplit(t.withColumn("_parts", parts))


def _resplit(t: DataFrame) -> DataFrame:
    """Tokens anew from the pieces (`_parts`) each became, so that later passes see new tags as tags."""
    out = t.select("doc_id", "pos", F.posexplode_outer("_parts").alias("_i", "tok")).filter("tok is not null")
    kind, tag = K.classify(F.col("tok"))
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "_i")) - 1
    return out.select("doc_id", ordinal.alias("pos"), "tok", kind.alias("kind"), tag.alias("tag"))


def resource_lines(toks: DataFrame, prefix: str = fixed.CLASS_PREFIX) -> DataFrame:
    """A line that opens with a resource marker and has text after it gets the class."""
    w = K.doc_window()
    t = _neighbours(toks)
    line_open = F.col("tag").isin("p", "li") & (F.col("kind") == "open")
    kind = F.regexp_extract(F.col("tok"), rf"{IU}^\[{WS}*({fixed.RESOURCE_WORDS}){WS}*:{WS}*\]$", 1)
    opens = (F.col("p1") == "p") | F.col("p1").rlike(r"(?i)^<li\b")
    rest = F.col("n1").isNotNull() & (F.col("n1") != "/p") & ~F.col("n1").rlike(r"(?i)^</li>")
    t = t.withColumn("_k", F.when((F.col("kind") == "bracket") & (kind != "") & opens & rest,
                                  T.strip_diacritics(F.lower(kind))))
    nxt = F.expr("lead(coalesce(_k, case when tok rlike '^\\\\s*$' then null else '' end)) ignore nulls over (partition by doc_id order by pos)")
    t = t.withColumn("_n", nxt).withColumn("_after", F.lag("_k").over(w))
    cls = F.concat(F.lit(f"{prefix}recurso {prefix}recurso_"), F.col("_n"))
    new = (F.when(F.col("_k").isNotNull(), "")
           .when(line_open & (F.col("_n") != ""), add_class(F.col("tok"), cls))
           .when(F.col("_after").isNotNull() & (F.col("kind") == "text"), sub(F.col("tok"), rf"^{NBSP_OR_WS}+", ""))
           .otherwise(F.col("tok")))
    return _keep(t.select("doc_id", "pos", F.coalesce(new, F.col("tok")).alias("tok"), "kind", "tag"))


def list_starts(toks: DataFrame) -> DataFrame:
    """Adds `start_at` to top-level ordered lists: the number their first item carries on
    from the list they continue (null: nothing to write)."""
    t = K.with_depth(toks)
    w = K.doc_window()
    is_open, top = F.col("kind") == "open", F.col("starts")
    ol = top & (F.col("tag") == "ol")
    reset = top & (F.col("tag").rlike("^h[1-6]$") | (F.col("tag") == "ul"))
    explicit = F.when(ol, F.coalesce(T.attr(F.col("tok"), "start").try_cast("int"), F.lit(1)))
    has_start = ol & T.has_attr(F.col("tok"), "start")
    item = (F.col("tag") == "li") & is_open & (F.col("depth") == 1)
    # the top-level list a token lies in is what the last start of a block says
    t = (t.withColumn("_ol", ol).withColumn("_own", has_start).withColumn("_start", explicit).withColumn("_li", item)
         .withColumn("_new", reset | has_start).withColumn("_blk", F.last(F.when(top, ol), ignorenulls=True).over(K.upto(w))))
    # a run begins at a reset or at a list with its own start: counts of a run are those of the document less what they were there
    t = (t.withColumn("_items", F.coalesce(F.sum((F.col("_li") & F.col("_blk")).cast("int")).over(K.before(w)), F.lit(0)))
         .withColumn("_lists", F.coalesce(F.sum(F.col("_ol").cast("int")).over(K.before(w)), F.lit(0))))
    at = F.when(F.col("_new"), F.struct("_items", "_lists", F.when(F.col("_own"), F.col("_start") - 1).alias("base")))
    t = t.withColumn("_at", F.last(at, ignorenulls=True).over(K.upto(w)))
    items = F.col("_items") - F.coalesce("_at._items", F.lit(0))
    base = F.coalesce("_at.base", F.lit(0))
    first = F.col("_lists") == F.coalesce("_at._lists", F.lit(0))
    start = F.when(F.col("_ol") & ~F.col("_own") & ~first & (items + base > 0), items + base + 1)
    return t.withColumn("start_at", start).drop("_ol", "_own", "_start", "_li", "_new", "_blk", "_items", "_lists", "_at")


def continue_lists(toks: DataFrame) -> DataFrame:
    t = list_starts(toks)
    new = F.when(F.col("start_at").isNotNull(),
                 F.concat(F.regexp_extract("tok", r"(?s)^(.*?)>$", 1), F.lit(' start="'),
                          F.col("start_at").cast("string"), F.lit('">'))).otherwise(F.col("tok"))
    return t.select("doc_id", "pos", new.alias("tok"), "kind", "tag")


def with_anchor(toks: DataFrame) -> DataFrame:
    a = F.col("tag") == "a"
    step = F.when(a & (F.col("kind") == "open"), 1).when(a & (F.col("kind") == "close"), -1).otherwise(0)
    return toks.withColumn("in_anchor", F.sum(step).over(K.upto(K.doc_window())) > 0)


# addresses in written text: a character that ends an address also ends it when written as an entity
_URL_CHAR = rf"""(?:(?!&(?:lt|gt|quot|apos|nbsp|#39|#34|#60|#62|#96|#160|#x27|#xA0);)(?!{WS})[^<>"'`)\]])"""
URL = rf"(?:https?://{_URL_CHAR}+|www\.{_URL_CHAR}+)"
# punctuation after an address; the semicolon of an ampersand belongs to it
URL_TAIL = r"(?:[.,:!?]|(?<!&amp);)+$"


def _href(url: Column) -> Column:
    return F.when(url.startswith("www."), F.concat(F.lit("https://"), url)).otherwise(url)


def found_links(toks: DataFrame) -> DataFrame:
    """(doc_id, pos, ord, url, href): plain addresses in text outside anchors."""
    t = with_anchor(toks).filter("kind in ('text', 'bracket') and not in_anchor")
    hits = t.select("doc_id", "pos", F.posexplode_outer(F.regexp_extract_all("tok", F.lit(URL), F.lit(0))).alias("ord", "raw")).filter("raw is not null")
    url = T.swap(F.regexp_replace("raw", URL_TAIL, ""), ("&amp;", "&"))
    return hits.select("doc_id", "pos", "ord", url.alias("url"), _href(url).alias("href"))


def autolink(toks: DataFrame) -> DataFrame:
    def one(m: Column) -> Column:
        url = F.regexp_replace(m, URL_TAIL, "")
        return F.concat(F.lit('<a href="'), _href(url), F.lit('">'), url, F.lit("</a>"), F.substring(m, F.length(url) + 1, F.length(m)))
    t = with_anchor(toks)
    plain = F.col("kind").isin("text", "bracket") & ~F.col("in_anchor") & F.col("tok").rlike(URL)
    new = F.when(plain, rewrite_matches(F.col("tok"), URL, one)).otherwise(F.col("tok"))
    out = t.withColumn("tok", new)
    return _resplit(out.withColumn("_parts", F.when(F.col("kind") == "text", F.regexp_extract_all("tok", F.lit(r"<[^>]+>|[^<]+|<"), F.lit(0)))
                                   .otherwise(F.array("tok"))))


def link_flags(toks: DataFrame) -> DataFrame:
    """(doc_id, pos, href, external): anchors with an address."""
    href = T.strip(T.attr(F.col("tok"), "href"))
    return (toks.filter("tag = 'a' and kind = 'open'").select("doc_id", "pos", href.alias("href"))
            .filter("href is not null").withColumn("external", F.col("href").rlike("(?i)^https?://")))


def external_links(toks: DataFrame) -> DataFrame:
    tok = F.col("tok")
    hit = (F.col("tag") == "a") & (F.col("kind") == "open") & T.strip(T.attr(tok, "href")).rlike("(?i)^https?://")
    bare = F.regexp_replace(tok, r"""(?i)\s(target|rel)=("[^"]*"|'[^']*')""", "")
    new = F.concat(F.regexp_extract(bare, r"(?s)^(.*?)>$", 1), F.lit(' target="_blank" rel="noopener noreferrer">'))
    return toks.withColumn("tok", F.when(hit, new).otherwise(tok))


IMAGE_BLOCKS = fold.IMAGE_BLOCKS


def image_blocks(toks: DataFrame) -> DataFrame:
    """Image tokens with their block's text length and image count, and their size.

    The block of a token is the innermost open one, also after a block inside it has closed:
    at each depth the block opened last is the one still open. Its text and images are those
    counted between its tags, inner blocks included.
    """
    w = K.doc_window()
    blk = F.coalesce(F.col("tag").isin(IMAGE_BLOCKS), F.lit(False))
    opens, closes = blk & (F.col("kind") == "open"), blk & (F.col("kind") == "close")
    img = F.col("tag") == "img"
    txt = F.when(F.col("kind").isin("text", "bracket"), F.length(T.plain_text(F.col("tok")))).otherwise(0)
    t = (toks.withColumn("_step", F.when(opens, 1).when(closes, -1).otherwise(0)).withColumn("_txt", txt)
         .withColumn("_img", F.coalesce(img, F.lit(False)).cast("int")))
    t = t.withColumn("_depth", F.sum("_step").over(K.upto(w)) + F.when(closes, 1).otherwise(0))
    t = t.withColumn("_txt", F.sum("_txt").over(K.upto(w))).withColumn("_img", F.sum("_img").over(K.upto(w)))
    d = Window.partitionBy("doc_id", "_depth").orderBy("pos")
    last = F.last(F.when(opens, F.col("pos")), ignorenulls=True).over(K.upto(d))
    t = t.withColumn("blk", F.when(F.col("_depth") > 0, last).otherwise(-1))
    b = Window.partitionBy("doc_id", "_depth", "blk")
    t = (t.withColumn("blk_text", F.max("_txt").over(b) - F.min("_txt").over(b))
         .withColumn("blk_imgs", F.max("_img").over(b) - F.min("_img").over(b)).drop("_step", "_txt", "_img", "_depth"))
    tok = F.col("tok")
    aw, ah = T.attr(tok, "data-w").try_cast("int"), T.attr(tok, "data-h").try_cast("int")
    sniff = F.when(img & tok.contains("data:image/"), I.data_url_size(T.attr(tok, "src")))
    inline = img & (F.col("blk") >= 0) & ((F.col("blk_text") > 0) | (F.col("blk_imgs") > 1))
    both = aw.isNotNull() & ah.isNotNull()
    return (t.withColumn("inline", F.coalesce(inline, F.lit(False)))
            .withColumn("img_w", F.when(both, aw.cast("bigint")).otherwise(sniff["width"]))
            .withColumn("img_h", F.when(both, ah.cast("bigint")).otherwise(sniff["height"])))


def inline_images(toks: DataFrame, prefix: str = fixed.CLASS_PREFIX) -> DataFrame:
    t = image_blocks(toks)
    tok = F.col("tok")
    bare = F.regexp_replace(tok, r"""(?i)\sdata-[wh]=("[^"]*"|'[^']*')""", "")
    cls = add_class(bare, F.lit(prefix + "img_inline"))
    px = F.concat(F.lit("width:"), F.col("img_w").cast("string"), F.lit("px;height:"), F.col("img_h").cast("string"), F.lit("px"))
    # the size replaces an earlier one; an earlier style stays before it
    own = F.coalesce(T.attr(tok, "style"), F.lit(""))
    style = F.when(own != "", F.concat(own, F.lit(";"), px)).otherwise(px)
    free = F.regexp_replace(cls, r"""(?i)\s(width|height|style)=("[^"]*"|'[^']*'|[^\s>"']+)""", "")
    sized = F.when((F.col("img_w") >= 1) & (F.col("img_h") >= 1), F.concat(
        F.regexp_extract(free, r"(?s)^(.*?)\s*/?>$", 1), F.lit(' width="'), F.col("img_w").cast("string"), F.lit('" height="'),
        F.col("img_h").cast("string"), F.lit('" style="'), style, F.lit('" />'))).otherwise(cls)
    new = F.when(F.col("tag") == "img", F.when(F.col("inline"), sized).otherwise(bare)).otherwise(tok)
    return t.select("doc_id", "pos", F.coalesce(new, tok).alias("tok"), "kind", "tag")


# --- the fold -----------------------------------------------------------------------

ROW_PASSES = [("iframes", embed_iframes), ("markers", normalize_markers)]
TOKEN_PASSES = [
    ("boxes", form_boxes), ("tables", orient_tables), ("table structure", structure_tables),
    ("line breaks", split_resource_lines), ("resource lines", resource_lines), ("ordered lists", continue_lists),
    ("autolink", autolink), ("external links", external_links), ("inline images", inline_images),
]


def apply_passes(docs: DataFrame, row_passes=None, token_passes=None, placed: bool = False) -> DataFrame:
    """All passes in their fixed order as one plan: docs in, docs out.

    One exchange places the documents; what follows it stays with the document's row. TOKEN_PASSES walk its tokens there
    (`fold`); other token passes are windows or projections of a token table.
    """
    done = reduce(lambda d, p: d.transform(p[1]), row_passes or ROW_PASSES, K.by_doc(docs.select("doc_id", "html"), placed))
    if token_passes and token_passes != TOKEN_PASSES:
        return K.untokenize(reduce(lambda d, p: d.transform(p[1]), token_passes, K.tokens(done, placed=True)))
    return walk_passes(done)


def walk_passes(docs: DataFrame, prefix: str = fixed.CLASS_PREFIX) -> DataFrame:
    """TOKEN_PASSES over placed documents, each in its row; documents without a token have no row. Documents of one id are one list of
    tokens. The sizes of images that only their own bytes tell are read afterwards, by Spark."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", K.clean_markup(F.col("html")).alias("html")).groupBy("doc_id").agg(F.collect_list("html").alias("html"))
    made = texts.mapInArrow(fold.run(prefix, URL, URL_TAIL), f"doc_id {kind}, {fold.MADE}")

    def sized(i: Column) -> Column:
        return T.let(I.data_url_size(T.attr(i["tok"], "src")), lambda s: F.when((s["width"] >= 1) & (s["height"] >= 1), F.concat(
            i["before"], F.lit(' width="'), s["width"].cast("string"), F.lit('" height="'), s["height"].cast("string"), F.lit('" style="'), i["style"], F.lit("width:"),
            s["width"].cast("string"), F.lit("px;height:"), s["height"].cast("string"), F.lit('px" />'))).otherwise(i["plain"]))

    tags = F.concat(F.transform("images", sized), F.array(F.lit("")))
    whole = F.array_join(F.flatten(F.zip_with("html", tags, lambda h, t: F.array(h, t))), "")
    return made.select("doc_id", F.when(F.size("images") == 0, F.get("html", F.lit(0))).otherwise(whole).alias("html"))


# --- embedded images ------------------------------------------------------------------

def image_path(url: Column) -> Column:
    return F.concat(F.lit(f"{fixed.RESOURCE_DIR}/img_"), F.sha2(I.data_url_bytes(url), 256), F.lit("."),
                    I.image_ext(I.data_url_subtype(url)))


def extract_images(docs: DataFrame) -> DataFrame:
    """Data URLs become paths named by content; every occurrence is rewritten."""
    return rewrite(docs, I.DATA_URL, image_path)


def image_refs(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, sha, path, content): one row per occurrence of an embedded image."""
    urls = F.regexp_extract_all("html", F.lit(I.DATA_URL), F.lit(0))
    u = docs.select("doc_id", F.posexplode_outer(urls).alias("ord", "url")).filter("url is not null")
    content = I.data_url_bytes(F.col("url"))
    return u.select("doc_id", "ord", F.sha2(content, 256).alias("sha"), image_path(F.col("url")).alias("path"), content.alias("content"))


def image_store(refs: DataFrame) -> DataFrame:
    """One row per distinct image with its number of references and documents.

    Both counts combine on the map side: first per image and document, then per image, so
    an image that a third of the corpus carries arrives as one row per task.
    """
    per_doc = refs.groupBy("sha", "doc_id").agg(F.count("*").alias("n"), F.min("path").alias("path"), F.first("content").alias("content"))
    return per_doc.groupBy("sha").agg(F.min("path").alias("path"), F.sum("n").alias("refs"), F.count("*").alias("docs"),
                                      F.first("content").alias("content"))
