"""Legacy course packages: the serialised object tree as tables, pages, items, resources."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import images as I
from ..functions import text as T
from . import tree
from .tokens import by_doc

XML_TOKEN = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[^>]+>|[^<]+"
XML_TAG = r"^</?(?:[\w.-]+:)?([\w.-]+)"
NODE = fixed.CLASS_NODE
TITLES = ["_title", "title"]
CONTENT = ["content_w_resourcePaths", "_content", "content"]


def repair_escapes(xml: Column) -> Column:
    """`\\xNN` that an old writer left in the text becomes its character, where XML allows that character."""
    parts = F.regexp_extract_all(xml, F.lit(r"(?s)\\x(?:0[9AaDd]|[2-9A-Fa-f][0-9A-Fa-f])|\\|[^\\]+"), F.lit(0))

    def one(p: Column) -> Column:
        code = F.conv(F.substring(p, 3, 2), 16, 10).cast("int")
        # two hex digits reach U+00FF: above U+007F the character takes two bytes
        wide = F.concat(F.lpad(F.hex(F.shiftright(code, 6) + 0xC0), 2, "0"), F.lpad(F.hex(code.bitwiseAND(0x3F) + 0x80), 2, "0"))
        made = F.decode(F.unhex(F.when(code < 0x80, F.lpad(F.hex(code), 2, "0")).otherwise(wide)), "UTF-8")
        return F.when(p.startswith("\\x") & (F.length(p) == 4), made).otherwise(p)

    return F.when(xml.contains("\\x"), F.array_join(F.transform(parts, one), "")).otherwise(xml)


#: kinds of tokens, and what start tags mean
OPEN, CLOSE, VOID, TEXT, SKIP = range(5)
PLAIN, DICTIONARY, LIST, INSTANCE, REFERENCE, KEY = range(6)
MEANING = {"dictionary": DICTIONARY, "list": LIST, "instance": INSTANCE, "reference": REFERENCE}
LABEL = {INSTANCE: "reference", REFERENCE: "key", KEY: "value"}
RELATED = ("pos int, depth int, close_pos int, parent_pos int, sib int, key string, owner int, list_key string, list_owner int, target int, "
           "in_title boolean, widgets array<int>, tok string, tag string, inner string")
_TYPES = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
RELATED_TYPE = pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in RELATED.split(", "))])
#: elements that a worker holds before it hands them on, unless one package has more
FLUSH_ELEMENTS = 20_000
_TOKENS, _TAG = re.compile(XML_TOKEN), re.compile(XML_TAG, re.ASCII)
_NUMBER = re.compile("&#(?:[xX]([0-9a-fA-F]+)|([0-9]+));")
_ATTR = {name: re.compile(rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.ASCII) for name in ("role", "value", "reference", "key")}


def _character(m: re.Match) -> str:
    n = int(m[1], 16) if m[1] else int(m[2])
    return chr(n) if n < 0xD800 or 0xDFFF < n < 0x110000 else "\ufffd"


def attribute(tok: str, name: str) -> str:
    """`T.attr` of one tag, '' without the attribute."""
    m = _ATTR[name].search(tok)
    raw = m[1] if m else ""
    if raw.startswith(('"', "'")):
        raw = raw[1:-1]
    if "&" in raw:
        raw = _NUMBER.sub(_character, raw)
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            raw = raw.replace(entity, char)
    return raw


@lru_cache(maxsize=1 << 14)
def read_token(tok: str) -> tuple[int, int, str, str | None]:
    """(kind, meaning, tag, label) of a token; the label is the text of a key string and the number of an instance or a reference."""
    if tok.startswith(("<?", "<!--")):
        return SKIP, PLAIN, "", None
    m = _TAG.match(tok)
    if not m:
        return TEXT, PLAIN, "", None
    tag = m[1]
    if tok.startswith("</"):
        return CLOSE, PLAIN, tag, None
    what = MEANING.get(tag, PLAIN)
    if tag == "string" and attribute(tok, "role") == "key":
        what = KEY
    return VOID if tok.endswith("/>") else OPEN, what, tag, attribute(tok, LABEL[what]) if what in LABEL else None


def relate(toks: list[str]) -> list[list]:
    """The columns of RELATED for the elements of one package, in document order, by a stack of open elements.

    An end tag closes the element opened last; one that closes nothing is passed over. Of several instances with one number the last is
    meant. Linear in the tokens."""
    # element 0 stands for what is outside of all elements
    pos, depth, close, parent, sib, key, owner, list_key, list_owner, target, texts, tags, inner = ([None] for _ in range(13))
    what, children, named, above, stack, meant = [PLAIN], [0], [None], [0], [0], {}
    before, before_that, at = SKIP, SKIP, None
    for i, tok in enumerate(toks):
        kind, w, tag, name = read_token(tok) if tok[0] == "<" else (TEXT, PLAIN, "", None)
        if kind == SKIP:
            continue
        if kind == CLOSE:
            if len(stack) > 1:
                e = stack.pop()
                close[e] = i
                if before == TEXT and before_that == OPEN:
                    inner[e] = at
        elif kind == TEXT:
            at = tok
        else:
            up, n = stack[-1], len(pos)
            children[up] += 1
            around = what[up]
            # in a dictionary a key string names the element after it
            k = named[up] if around == DICTIONARY and w != KEY else None
            named[up] = name if w == KEY else None
            pos.append(i)
            depth.append(len(stack))
            close.append(i if kind == VOID else None)
            parent.append(pos[up])
            sib.append(children[up])
            key.append(k)
            owner.append(None if k is None else parent[up])
            list_key.append(key[up] if around == LIST else None)
            list_owner.append(owner[up] if around == LIST else None)
            target.append(i if w == INSTANCE else name if w == REFERENCE else None)
            texts.append(tok)
            tags.append(tag)
            inner.append(None)
            what.append(w)
            above.append(up)
            children.append(0)
            named.append(None)
            if w == INSTANCE and name:
                meant[name] = i
            if kind == OPEN:
                stack.append(n)
        before_that, before = before, kind
    target = [meant.get(t) if isinstance(t, str) else t for t in target]
    titles = {t for k, t in zip(key, target, strict=True) if t is not None and k in TITLES}
    in_title = [o in titles for o in owner]
    shown = {t for k, t in zip(list_key, target, strict=True) if t is not None and k == "idevices"}
    widgets = [()]
    for e in range(1, len(pos)):
        up = above[e]
        widgets.append((*widgets[up], pos[up]) if pos[up] in shown else widgets[up])
    widgets = [x if w == INSTANCE and x else None for w, x in zip(what, widgets, strict=True)]
    return [c[1:] for c in (pos, depth, close, parent, sib, key, owner, list_key, list_owner, target, in_title, widgets, texts, tags, inner)]


def _relate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`relate` for every package (doc_id, xml) of the batches: a row an element."""
    for batch in batches:
        rows, columns = [], [[] for _ in RELATED_TYPE]

        def made() -> pa.RecordBatch:
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, f.type) for c, f in zip(columns, RELATED_TYPE, strict=True))]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *RELATED_TYPE.names])

        for row, xml in enumerate(batch.column(1)):
            if not xml.is_valid:
                continue
            package = relate(_TOKENS.findall(xml.as_py()))
            rows += [row] * len(package[0])
            for column, more in zip(columns, package, strict=True):
                column += more
            if len(rows) >= FLUSH_ELEMENTS:
                yield made()
                rows, columns = [], [[] for _ in RELATED_TYPE]
        if rows:
            yield made()


def xml_nodes(docs: DataFrame, placed: bool = False) -> DataFrame:
    """One row per XML element of docs(doc_id, xml), in document order, with all that relates it to others, so that what
    follows needs no joins of elements:

    doc_id, pos, depth, tag, tok, value, close_pos, parent_pos, sib;
    key, owner: the name a dictionary gives the element and the instance the dictionary belongs to;
    list_key, list_owner: the same of the list the element is a member of;
    target: the instance it is, or the one its reference names;
    in_title: whether the instance that owns it is what a title names; widgets: the widgets around an instance, outermost first.

    A package is read once, within its row: cut into tokens and related by a stack (`relate`), and handed on as rows, some thousands at a
    time, so that a worker holds few packages however many a task has. What texts mean stays with Spark. Placement by package does not
    outlast that step: what groups or joins elements later plans its own exchange. A null text has no elements.
    """
    base = by_doc(docs.select("doc_id", "xml"), placed)
    rows = base.select("doc_id", repair_escapes(F.col("xml")).alias("xml"))
    e = rows.mapInArrow(_relate, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {RELATED}")
    plain = T.let(F.regexp_replace(F.coalesce("inner", F.lit("")), r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1"), T.unescape_xml)
    value = F.when(F.col("tag").isin("string", "unicode"), T.let(T.attr(F.col("tok"), "value"), lambda v: F.when(F.coalesce(v, F.lit("")) != "", v).otherwise(plain)))
    return e.select("doc_id", "pos", "depth", "tag", "tok", value.alias("value"), "close_pos", "parent_pos", "sib", "key", "owner", "list_key", "list_owner", "target",
                    "in_title", "widgets")


def class_of(tok: Column) -> Column:
    return T.attr(tok, "class")


def instances(nodes: DataFrame) -> DataFrame:
    """(doc_id, pos, depth, close_pos, class, ref)."""
    return nodes.filter("tag = 'instance'").select(
        "doc_id", "pos", "depth", "close_pos", class_of(F.col("tok")).alias("class"), T.attr(F.col("tok"), "reference").alias("ref"))


def fields(nodes: DataFrame) -> DataFrame:
    """(doc_id, owner, key, pos, tag, value, target): dictionary entries of instances."""
    return nodes.filter("key is not null").select("doc_id", "owner", "key", "pos", "tag", "value", "target")


def list_members(nodes: DataFrame, key: str) -> DataFrame:
    """(doc_id, owner, sib, target): resolved members of an instance's list field."""
    return nodes.filter((F.col("list_key") == key) & F.col("target").isNotNull()).select("doc_id", F.col("list_owner").alias("owner"), "sib", "target")


def references(nodes: DataFrame) -> DataFrame:
    """(doc_id, target, ref_key, class): references with the class of the instance each names. Both meet in one aggregate a package and
    instance, so that packages are read once."""
    tag, tok = F.col("tag"), F.col("tok")
    rows = nodes.filter("tag in ('instance', 'reference') and target is not null and doc_id is not null")
    met = rows.groupBy("doc_id", "target").agg(F.collect_list(F.when(tag == "reference", F.struct(T.attr(tok, "key").alias("ref_key")))).alias("refs"),
                                               F.collect_list(F.when(tag == "instance", F.struct(class_of(tok).alias("class")))).alias("named"))
    return met.select("doc_id", "target", "named", F.inline("refs")).select("doc_id", "target", "ref_key", F.inline("named"))


PAGE_TYPE = pa.struct([("page_ord", pa.int32()), ("node", pa.int32()), ("depth", pa.int32()), ("title", pa.string())])
#: what the walk reads of each list's structs, in this order
HELD = (("sib", "target", "owner"), ("owner", "target"), None, None, ("rank", "pos", "owner", "value", "target"), ("rank", "value", "owner"))


def walk_pages(edges, roots, nodes, package, titles=(), inner=()) -> list[tuple]:
    """Pages (page_ord, node, depth, title) of one package in reading order, from its edges and roots, tuples as in HELD. An edge back to a page that
    is open already is left out; the stack is explicit, so depth has no limit. A page's title is the text of its first title field, else the
    text inside the instance that field names."""
    known, below = set(nodes), {}
    for _sib, target, owner in sorted(edges, key=itemgetter(0, 1), reverse=True):
        if target in known:
            below.setdefault(owner, []).append(target)
    title_of, text_of = {}, {}
    for _rank, _pos, owner, value, target in sorted(titles, key=itemgetter(0, 1)):
        title_of.setdefault(owner, (value, target))
    for _rank, value, owner in sorted(inner, key=lambda t: (-t[0], t[1])):
        text_of[owner] = value

    def page(i: int, node: int, depth: int) -> tuple:
        value, target = title_of.get(node, (None, None))
        return i, node, depth, value or text_of.get(target) or fixed.PAGE_WITHOUT_TITLE

    starts = sorted((target for owner, target in roots if owner == package and target in known), reverse=True)
    if not starts:
        return [page(i, n, 0) for i, n in enumerate(sorted(known))]
    out, on_path, path, todo = [], set(), [], [(r, 0) for r in starts]
    while todo:
        node, depth = todo.pop()
        while len(path) > depth:
            on_path.discard(path.pop())
        if node in on_path:
            continue
        path.append(node)
        on_path.add(node)
        out.append(page(len(out), node, depth))
        todo += [(c, depth + 1) for c in below.get(node, [])]
    return out


def _rows(column: pa.Array, names: tuple[str, ...] | None) -> list:
    """The values of a column; lists of structs as lists of tuples of these fields."""
    if names is None:
        return column.to_pylist()
    held, ends = column.values, column.offsets.to_pylist()
    flat = list(zip(*(held.field(n).to_pylist() for n in names), strict=True))
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def _walk(batches):
    """`walk_pages` for every package of the batches: doc_id, edges, roots, nodes, package and, where titles are asked for, title fields and texts."""
    for batch in batches:
        ends, flat = [0], []
        for row in zip(*(_rows(c, names) for c, names in zip(batch.columns[1:], HELD)), strict=True):
            flat += walk_pages(*row)
            ends.append(len(flat))
        columns = zip(*flat, strict=True) if flat else [[]] * len(PAGE_TYPE)
        ps = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PAGE_TYPE, strict=True)], fields=list(PAGE_TYPE))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ps)], names=["doc_id", "ps"])


def pages(nodes: DataFrame) -> DataFrame:
    """(doc_id, page_ord, depth, title, node): pages in reading order with their titles.

    A tree lies within one package: its edges meet there as pairs of positions, with the title fields, in one aggregate a
    package, whatever the depth. A package without a root page lists all its nodes at depth 0.
    """
    n = lambda c: F.col(c).alias(c)
    known, text = F.col("target").isNotNull(), F.nullif("value", F.lit("")).alias("value")
    of = lambda name: F.col("class") == name
    rank = lambda keys: F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key")).cast("int").alias("rank")
    counts = (F.col("tag") == "instance") | (F.col("list_key") == "children") | F.col("key").isin(["root", *TITLES, *CONTENT])
    rows = nodes.filter(counts).withColumn("class", F.when(F.col("tag") == "instance", class_of(F.col("tok")))).select(
        "doc_id", F.when((F.col("list_key") == "children") & known, F.struct(F.col("list_owner").alias("owner"), n("sib"), n("target"))).alias("edge"),
        F.when((F.col("key") == "root") & known, F.struct(n("owner"), n("target"))).alias("root"),
        F.when(of(NODE), F.col("pos")).alias("node"), F.when(of(fixed.CLASS_PACKAGE), F.col("pos")).alias("package"),
        F.when(F.col("key").isin(TITLES), F.struct(n("owner"), rank(TITLES), n("pos"), text, n("target"))).alias("title"),
        F.when(F.col("in_title") & F.col("key").isin(CONTENT) & text.isNotNull(), F.struct(n("owner"), rank(CONTENT), text)).alias("inner"))
    held = ("edge", "root", "node", "package", "title", "inner")
    trees = rows.groupBy("doc_id").agg(*[F.collect_list(c).alias(c) for c in ("edge", "root", "node")], F.min("package").alias("package"),
                                       *[F.collect_list(c).alias(c) for c in ("title", "inner")])
    key = nodes.schema["doc_id"].dataType.simpleString()
    trees = trees.select("doc_id", *held[:3], "package", *held[4:])
    p = trees.mapInArrow(_walk, f"doc_id {key}, ps array<struct<page_ord:int,node:int,depth:int,title:string>>").select("doc_id", F.inline("ps"))
    return p.select("doc_id", "page_ord", "depth", "title", "node")


def page_tree(nodes: DataFrame) -> DataFrame:
    """(doc_id, page_ord, node, depth): the tree alone."""
    return pages(nodes).select("doc_id", "page_ord", "node", "depth")


def package_info(nodes: DataFrame) -> DataFrame:
    """(doc_id, title, author, language, error): a package's own texts, and why it cannot be read, null if it can."""
    is_a = lambda name: (F.col("tag") == "instance") & (class_of(F.col("tok")) == name)
    first = F.min(F.when(is_a(fixed.CLASS_PACKAGE), F.col("pos"))).over(Window.partitionBy("doc_id"))
    mine = F.col("owner") == F.col("_package")
    text = lambda k: F.coalesce(F.max(F.when(mine & (F.col("key") == k), F.col("value"))), F.lit(""))
    error = F.when(F.max("_package").isNull(), fixed.ERR_NO_PACKAGE).when(F.count_if(is_a(NODE)) == 0, fixed.ERR_NO_PAGES)
    return nodes.withColumn("_package", first).groupBy("doc_id").agg(
        T.blank_to(text("_title"), F.lit(fixed.PACKAGE_TITLE)).alias("title"), text("_author").alias("author"), text("_lang").alias("language"), error.alias("error"))


NAMES = {"t": "_title", "dir": "_iDeviceDir", "tn": "_typeName", "gn": "__name__"}


def widgets(nodes: DataFrame) -> DataFrame:
    """(doc_id, target, page, sib, class, t, dir, tn, gn, areas): a row for each place where a page lists a widget, with the widget's names and the
    text fields (pos, html) below it, at any depth and behind closed inner widgets.

    Two aggregates, each keyed by package and instance: what belongs to an instance (its tag, its fields, the lists it stands in) becomes its row;
    then text fields go to the widgets around them. A text field listed nowhere and a widget that is nothing but listed meet there."""
    own, listed = F.col("tag") == "instance", (F.col("list_key") == "idevices") & F.col("target").isNotNull()
    field = F.col("key").isin([*CONTENT, *NAMES.values()])
    instance = F.struct(F.col("pos").alias("inst"), class_of(F.col("tok")).alias("class"), "widgets")
    none = F.lit(None)
    of_field = F.struct(F.col("owner").alias("inst"), F.col("key"), F.nullif("value", F.lit("")).alias("value"))
    of_list = F.struct(F.col("target").alias("inst"), F.col("list_owner").alias("page"), "sib")
    rows = nodes.filter(own | listed | field).select(
        "doc_id", F.when(own, instance).alias("i"), F.when(field & F.col("owner").isNotNull(), of_field).alias("f"), F.when(listed, of_list).alias("l"))
    # an instance that is a member of a list, or a field's value besides, counts for each
    roles = F.array(*[F.when(F.col(c).isNotNull(), F.struct(
        F.col(f"{c}.inst").alias("inst"), *[(F.col(c) if c == o else none.cast(rows.schema[o].dataType)).alias(o) for o in "ifl"])) for c in "ifl"])
    each = rows.select("doc_id", F.inline(F.filter(roles, lambda x: x.isNotNull())))
    text = lambda k: F.max(F.when(F.col("f.key") == k, F.col("f.value")))
    inst = each.groupBy("doc_id", "inst").agg(
        F.max("i.class").alias("class"), F.max("i.widgets").alias("widgets"), F.coalesce(*[text(k) for k in CONTENT]).alias("html"),
        *[text(k).alias(n) for n, k in NAMES.items()], F.collect_list("l").alias("places"))
    shown = F.when(F.size("places") > 0, F.struct("class", *NAMES, "places"))
    is_area = F.col("class").endswith(".TextAreaField") & (T.strip(F.coalesce("html", F.lit(""))) != "")
    area = F.when(is_area, F.struct(F.col("inst").alias("pos"), "html"))
    inst = inst.select("doc_id", "inst", "widgets", shown.alias("shown"), area.alias("area"))
    to = F.concat(F.when(F.col("shown").isNotNull(), F.array(F.struct(F.col("inst").alias("target"), F.lit(True).alias("own")))).otherwise(F.array()),
                  F.when(F.col("area").isNotNull(), F.transform(F.coalesce("widgets", F.array()), lambda w: F.struct(w.alias("target"), F.lit(False).alias("own"))))
                  .otherwise(F.array()))
    met = inst.select("doc_id", "shown", "area", F.inline(to)).groupBy("doc_id", "target").agg(
        F.first(F.when(F.col("own"), F.col("shown")), ignorenulls=True).alias("shown"),
        F.array_sort(F.collect_list(F.when(~F.col("own"), F.col("area")))).alias("areas"))
    met = met.filter("shown is not null").select("doc_id", "target", "areas", "shown.class", *[f"shown.{n}" for n in NAMES], F.inline("shown.places"))
    return met.select("doc_id", "target", "page", "sib", "class", *NAMES, "areas")


def text_areas(nodes: DataFrame) -> DataFrame:
    """(doc_id, target, pos, html): the text fields below each widget."""
    return widgets(nodes).select("doc_id", "target", F.inline("areas")).distinct()


def items(nodes: DataFrame, pgs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, warnings): items(doc_id, page_ord, item_ord, type, title, field_ord, html)
    with one row per HTML field; widgets without text become warnings."""
    on_page = pgs.select("doc_id", "page_ord", F.col("title").alias("page_title"), F.col("node").alias("page"))
    i = widgets(nodes).filter("class is not null").join(on_page, ["doc_id", "page"])
    last = F.element_at(F.split("class", r"\."), -1)
    kind = (F.when(F.col("class").endswith(".JsIdevice"), F.coalesce("dir", "tn", last))
            .when(F.col("class").endswith(".GenericIdevice"), F.coalesce("gn", last)).otherwise(last))
    i = i.select("doc_id", "page_ord", "page_title", F.col("sib").alias("item_ord"), kind.alias("type"), T.strip(F.coalesce("t", F.lit(""))).alias("title"), "areas")
    warn = i.filter(F.size("areas") == 0).select("doc_id", "page_ord", "item_ord", F.concat(
        F.lit("En la página «"), "page_title", F.lit("»: iDevice «"), T.blank_to(F.col("title"), F.col("type")), F.lit("» sin texto extraíble, omitido.")).alias("warning"))
    with_text = i.select("doc_id", "page_ord", "item_ord", "type", "title", F.posexplode("areas").alias("field_ord", "area"))
    return with_text.select("doc_id", "page_ord", "item_ord", "type", "title", "field_ord", "area.html"), warn


def summary(pgs: DataFrame, itms: DataFrame, resources: DataFrame, warnings: DataFrame) -> DataFrame:
    """(doc_id, pages, items, images, warnings) per package."""
    def n(d, c, name):
        return d.groupBy("doc_id").agg(c.alias(name))
    out = n(pgs, F.count("*"), "pages")
    out = out.join(n(itms.select("doc_id", "page_ord", "item_ord").distinct(), F.count("*"), "items"), "doc_id", "left")
    out = out.join(n(resources, F.count("*"), "images"), "doc_id", "left").join(n(warnings, F.count("*"), "warnings"), "doc_id", "left")
    return out.na.fill(0)


# --- resources ---------------------------------------------------------------------------

def join_resources(refs: DataFrame, resources: DataFrame) -> DataFrame:
    """Adds `name`, `found` and `status` to refs(doc_id, …, src): resources(doc_id, path)
    are looked up by name, then by the name with blanks as underscores."""
    r = refs.withColumn("name", T.resource_name(F.col("src"))).withColumn("alt", F.replace("name", F.lit(" "), F.lit("_")))
    res = resources.select("doc_id", "path").distinct()
    r = (r.join(res.select("doc_id", F.col("path").alias("name"), F.col("path").alias("_a")), ["doc_id", "name"], "left")
          .join(res.select("doc_id", F.col("path").alias("alt"), F.col("path").alias("_b")), ["doc_id", "alt"], "left"))
    found = F.coalesce("_a", "_b")
    ext = I.word_image_ext(F.element_at(F.split("name", r"\."), -1))
    status = (F.when(F.col("src").rlike("(?i)^https?:"), "external").when(F.col("src").rlike("(?i)^data:image/(png|jpe?g|gif|bmp);base64,."), "embedded")
              .when(found.isNull(), "missing").when(ext.isNull(), "unsupported").otherwise("found"))
    return r.withColumn("found", found).withColumn("status", status).drop("_a", "_b", "alt")


def notice(status: Column, src: Column) -> Column:
    say = lambda a: F.concat(F.lit(f"[{a}: "), src, F.lit("]"))
    return (F.when(status == "external", say("Imagen externa")).when(status == "missing", say("Imagen no encontrada"))
            .when(status == "unsupported", say("Imagen omitida")))


def class_markers(prefix: str = fixed.CLASS_PREFIX) -> dict[str, tuple[str, str]]:
    """Class to (kind, marker)."""
    out = {prefix + k: ("box", v) for k, v in fixed.BOX_LABELS.items()}
    out |= {f"{prefix}recurso_{k}": ("resource", f"{v}:") for k, v in (("video", "vídeo"), ("documento", "documento"), ("enlace", "enlace"))}
    return out | {f"{prefix}tabla_{k}": ("table", k) for k in ("horizontal", "vertical")}


def marker_of(tok: Column, kind: str, prefix: str = fixed.CLASS_PREFIX) -> Column:
    """The marker of a tag's first class of that kind, null without one."""
    table = {c: m for c, (k, m) in class_markers(prefix).items() if k == kind}
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    first = lambda c: F.try_element_at(m, F.get(F.filter(F.split(c, r"\s+"), lambda x: x.isin(list(table))), F.lit(0)))
    return T.let(T.attr(tok, "class"), lambda c: F.when(c.isNotNull(), first(c)))


def marked_lines(docs: DataFrame, prefix: str = fixed.CLASS_PREFIX, placed: bool = False) -> DataFrame:
    """(doc_id, ord, pos, sub, style, text): structured content written back as marker lines, from docs(doc_id, html).

    A box is its opening marker, its content and [fin]; a table comes after its orientation marker; a resource line starts with its marker;
    embedded content leaves a notice; preformatted text keeps its lines. Which text makes a line follows from the element stack, see
    `tree.lines`. `pos` and `sub` order the lines of a document, `ord` counts them.

    Lines are made within the document's row. Documents of one id write on the same lines, which meet by their place: only those are dealt
    again. `copies` in docs, where it is there, says how many documents have the id of each; otherwise they are counted.
    """
    base = docs if "copies" in docs.columns else by_doc(docs, placed).withColumn("copies", copies())
    rows = tree.document_lines(base.select("doc_id", "html", "copies"), lambda tok: marker_of(tok, "box", prefix).isNotNull())
    alone, shared = rows.filter("copies = 1"), rows.filter("copies > 1")
    whole = F.transform("entries", lambda e: _line_struct(e, F.when(e["said"] != tree.TEXT, _said(e, prefix)).otherwise(
        F.array_join(F.transform(e["parts"], lambda p: F.get("toks", p)), "")).alias("w")))
    texts = F.flatten(F.transform(whole, lambda e: _line_texts(e, prefix)))
    one = alone.select("doc_id", texts.alias("rows")).select("doc_id", F.posexplode_outer("rows").alias("ord", "x")).filter("x is not null")
    one = one.select("doc_id", "ord", "x.pos", "x.sub", "x.style", "x.text")

    pieces = F.transform("entries", lambda e: _line_struct(e, F.transform(e["parts"], lambda p: F.struct(
        p.alias("at"), F.when(e["said"] != tree.TEXT, _said(e, prefix)).otherwise(F.get("toks", p)).alias("w"))).alias("parts")))
    # Spark does not keep a placement across Python: documents are placed again while they are rows
    t = by_doc(shared.select("doc_id", pieces.alias("e"))).select("doc_id", F.explode_outer("e").alias("e")).filter("e is not null")
    head = F.struct("e.pre", "e.tok", "e.tag")
    t = t.groupBy("doc_id", "e.pos", "e.sub").agg(
        F.bool_or("e.mark").alias("mark"), F.first(F.when(F.col("e.tok").isNotNull(), head), ignorenulls=True).alias("h"),
        F.array_sort(F.flatten(F.collect_list("e.parts"))).alias("parts"))
    t = t.select("doc_id", F.struct("pos", "sub", "mark", F.coalesce("h.pre", F.lit(False)).alias("pre"), "h.tok", "h.tag",
                                    F.array_join("parts.w", "").alias("w")).alias("e"))
    t = t.select("doc_id", F.explode_outer(_line_texts(F.col("e"), prefix)).alias("x")).filter("x is not null").select("doc_id", "x.*")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "sub")) - 1
    return one.unionByName(t.withColumn("ord", nth))


def copies() -> Column:
    """How many documents have a document's id."""
    return F.count("*").over(Window.partitionBy("doc_id"))


def _line_struct(e: Column, *text: Column) -> Column:
    """An entry of a document's row (`tree.document_lines`) with the start tag of its line, for `_line_texts`."""
    return F.struct(e["pos"].alias("pos"), e["sub"].alias("sub"), (e["said"] != tree.TEXT).alias("mark"), e["pre"].alias("pre"),
                    F.get("toks", e["head"]).alias("tok"), F.get("seen", e["head"])["tag"].alias("tag"), *text)


def _said(e: Column, prefix: str) -> Column:
    """What an entry without text of its own says of its token."""
    tok = F.get("toks", F.get(e["parts"], F.lit(0)))
    given = lambda name: F.nullif(F.coalesce(T.attr(tok, name), F.lit("")), F.lit(""))
    source = F.coalesce(given("src"), given("data"), F.lit("sin URL"))
    return (F.when(e["said"] == tree.BOX_END, "[fin]")
            .when(e["said"] == tree.BOX_START, F.concat(F.lit("["), marker_of(tok, "box", prefix), F.lit("]")))
            .when(e["said"] == tree.TABLE_START, F.concat(F.lit("["), F.coalesce(marker_of(tok, "table", prefix), F.lit("horizontal")), F.lit("]")))
            .when(e["said"] == tree.NOTED, F.concat(F.lit("[Contenido incrustado omitido: "), source, F.lit("]"))))


def _line_texts(e: Column, prefix: str) -> Column:
    """The lines (pos, sub, style, text) of struct(pos, sub, mark, pre, tok, tag, w)."""
    tag, w = e["tag"], e["w"]
    style = (F.when(e["mark"], "marker").when(e["pre"], "pre")
             .when(tag.rlike("^h[1-6]$"), F.concat(F.lit("heading "), F.greatest(F.lit(2), F.substring(tag, 2, 1).cast("int")).cast("string")))
             .when(tag.isin("li", "td", "th"), tag).otherwise("p"))
    res = F.when(tag.isin("p", "li"), marker_of(e["tok"], "resource", prefix))
    said = lambda x: T.let(res, lambda r: F.when(r.isNotNull(), F.concat(F.lit("["), r, F.lit("] "), x)).otherwise(x))
    plain = T.let(T.plain_text(w), lambda x: F.when(x != "", F.array(said(x))).otherwise(F.array().cast("array<string>")))
    kept = F.split(T.unescape_xml(T.swap(F.regexp_replace(w, "\r\n?", "\n"), ("&nbsp;", " "))), "\n", -1)
    texts = F.when(e["mark"], F.array(w)).when(e["pre"], kept).otherwise(plain)
    return T.let(style, lambda s: F.transform(texts, lambda x, k: F.struct(e["pos"].alias("pos"), (e["sub"] + k).alias("sub"), s.alias("style"), x.alias("text"))))


def page_lines(pgs: DataFrame) -> DataFrame:
    """(doc_id, page_ord, style, text): the heading line of every page with its depth tag."""
    return pgs.select("doc_id", "page_ord", F.lit("heading 1").alias("style"), F.concat("title", T.depth_tag(F.col("depth"))).alias("text"))
