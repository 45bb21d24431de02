"""Numbers, outline, addresses, neighbours and tree of the pages of a document."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .. import fixed
from ..functions import text as T
from .tokens import before, upto


def page_window():
    return Window.partitionBy("doc_id").orderBy("page_idx")


def heading_numbers(pages: DataFrame) -> DataFrame:
    """Adds `number`: 1., 1.1., 1.1.1.; a level restarts the deeper ones, level 4 has none.

    Running totals only grow, so the total at the latest higher heading is their maximum,
    and one window serves every level.
    """
    w = page_window()
    p = pages
    for k in (1, 2, 3):
        p = p.withColumn(f"_s{k}", F.sum((F.col("level") == k).cast("int")).over(upto(w)))
    base2 = F.coalesce(F.max(F.when(F.col("level") == 1, F.col("_s2"))).over(upto(w)), F.lit(0))
    base3 = F.coalesce(F.max(F.when(F.col("level") <= 2, F.col("_s3"))).over(upto(w)), F.lit(0))
    n2, n3 = F.col("_s2") - base2, F.col("_s3") - base3
    num = (F.when(F.col("level") == 1, F.format_string("%d.", "_s1"))
           .when(F.col("level") == 2, F.format_string("%d.%d.", "_s1", n2))
           .when(F.col("level") == 3, F.format_string("%d.%d.%d.", "_s1", n2, n3)))
    return p.withColumn("number", num).drop("_s1", "_s2", "_s3")


def toc(pages: DataFrame, numbered: bool = True) -> DataFrame:
    """(doc_id, page_idx, id, title, level, number): levels up to 3, ids by page index."""
    p = heading_numbers(pages) if numbered else pages.withColumn("number", F.lit(None).cast("string"))
    return p.filter("level <= 3").select(
        "doc_id", "page_idx", F.concat(F.lit("section-"), F.col("page_idx").cast("string")).alias("id"),
        F.upper("title").alias("title"), "level", "number")


@F.pandas_udf(ArrayType(StringType()))
def free_names(slugs: pd.Series) -> pd.Series:
    """Each document's slugs in order, a taken one with the smallest free number from 2 on."""
    def named(row) -> list[str] | None:
        if row is None:
            return None
        out: list[str] = []
        used: set[str] = set()
        following: dict[str, int] = {}
        for s in row:
            name = s
            if s in used:
                k = following.get(s, 2)
                while f"{s}-{k}" in used:
                    k += 1
                following[s], name = k + 1, f"{s}-{k}"
            used.add(name)
            out.append(name)
        return out

    return slugs.map(named, na_action=None)


def page_hrefs(pages: DataFrame, around: bool = False) -> DataFrame:
    """Adds `href`: index.html, then html/<slug>.html with -2, -3, … on collisions. `around` adds `_before` and `_after`, the addresses
    beside it, for `page_neighbours`: pages leave the document's row with them, and need no placing again.

    A repeated slug takes the next number. Only where a document also has a slug that ends
    in a number can such a name be taken already; the slugs of those documents are named in
    order with the next free number of each, in time linear in their pages, the others by
    the count of the slug so far.
    """
    n = (F.col("page_idx") + 1).cast("string")
    slug = T.blank_to(T.slug(T.blank_to(F.col("title"), F.concat(F.lit("pagina-"), n))), F.concat(F.lit("pagina-"), n))
    d = Window.partitionBy("doc_id", "_slug").orderBy("page_idx")
    nth = F.sum((F.col("page_idx") > 0).cast("int")).over(upto(d))
    p = pages.withColumn("_slug", slug).withColumn("_nth", nth)
    cols = [c for c in p.columns if c not in ("doc_id", "page_idx")]
    g = p.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page_idx", *cols))).alias("ps"),
        ((F.max("_nth") > 1) & F.bool_or(F.col("_slug").rlike(r"-\d+$"))).alias("clash"))

    slugs = F.transform(F.filter("ps", lambda x: x["page_idx"] > 0), lambda x: x["_slug"])
    g = g.withColumn("names", free_names(F.when(F.col("clash"), slugs)))
    plain = lambda x: F.when(x["_nth"] > 1, F.concat(x["_slug"], F.lit("-"), x["_nth"].cast("string"))).otherwise(x["_slug"])
    href = lambda x: F.when(x["page_idx"] == 0, "index.html").otherwise(
        F.concat(F.lit("html/"), F.coalesce(F.get("names", x["page_idx"] - 1), plain(x)), F.lit(".html")))
    g = g.withColumn("hrefs", F.transform("ps", href))
    beside = {"href": 0, "_before": -1, "_after": 1} if around else {"href": 0}
    rows = F.transform("ps", lambda x, i: F.struct(x.alias("p"), *[F.get("hrefs", i + k).alias(name) for name, k in beside.items()]))
    return g.select("doc_id", F.inline_outer(rows)).select("doc_id", "p.*", *beside).drop("_slug", "_nth")


def page_neighbours(pages: DataFrame) -> DataFrame:
    """Adds `prev_href`, `next_href` relative to the page ('' at the ends); reads and drops `_before` and `_after` where pages have them."""
    w = page_window()
    given = "_before" in pages.columns
    last, following = (F.col("_before"), F.col("_after")) if given else (F.lag("href").over(w), F.lead("href").over(w))
    local = lambda c: F.regexp_replace(c, "^html/", "")
    prev = F.when(F.col("page_idx") == 0, "").when(F.col("page_idx") == 1, "../index.html").otherwise(local(last))
    nxt = F.when(F.col("page_idx") == 0, following).otherwise(local(following))
    return pages.withColumn("prev_href", prev).withColumn("next_href", F.coalesce(nxt, F.lit(""))).drop("_before", "_after")


def nav_tree(pages: DataFrame) -> DataFrame:
    """Adds `path` (page indexes from the root, zero-padded: its order is the menu's order),
    `depth` and `n_children`. Levels are bounded by 4, so three parent steps suffice.

    The parents of one document are an array beside its pages and looked up by index;
    children are counted on the same placement.
    """
    cols = [c for c in pages.columns if c != "doc_id"]
    d = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_idx", *[c for c in cols if c != "page_idx"]))).alias("ps"))
    d = d.withColumn("up", F.transform("ps", lambda x: x["parent_idx"]))
    # as wide as the largest index needs: no number is cut, and text order is page order
    width = F.greatest(F.lit(6), F.length(F.size("ps").cast("string")))
    pad = lambda c: F.lpad(c.cast("string"), width, F.lit("0"))

    def placed(x: Column) -> Column:
        a1 = x["parent_idx"]
        a2 = F.get("up", a1)
        a3 = F.get("up", a2)
        path = F.concat_ws("/", pad(a3), pad(a2), pad(a1), pad(x["page_idx"]))
        return F.struct(x.alias("p"), path.alias("path"))

    p = d.select("doc_id", F.inline_outer(F.transform("ps", placed))).select("doc_id", "p.*", "path")
    # every page counts once for itself and once, without its columns, for its parent
    both = p.select("doc_id", F.struct(*cols, "path").alias("_p"), F.explode(F.array("page_idx", "parent_idx")).alias("k")).filter("k is not null")
    own = F.col("k") == F.col("_p.page_idx")
    g = both.groupBy("doc_id", "k").agg(F.max(F.when(own, F.col("_p"))).alias("p"), F.count_if(~own).alias("n_children"))
    return g.select("doc_id", "p.*", (F.size(F.split("p.path", "/")) - 1).alias("depth"), "n_children")


def page_titles(pages: DataFrame) -> Column:
    return T.blank_to(F.col("title"), F.concat(F.lit("Página "), (F.col("page_idx") + 1).cast("string")))
