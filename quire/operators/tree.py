"""Elements of HTML documents by a stack of open elements, and the lines their text is written back as.

Start tags may end elements that are open (a block ends a paragraph, a list item the one before it, a cell the cell before it); end tags close
what is open above their partner; end tags without partner do nothing. That is a walk over one document's tags, linear in their
number, so it runs per row on Arrow batches: the row is the unit, nothing is shuffled, and only kinds and tag names cross to Python. Texts
stay with Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from . import tokens as K

ROOT = -1
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
#: start tags that end an open paragraph
PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form header hr main nav ol p pre section table ul".split()) | HEADINGS
#: what a start tag ends, and the elements that shield what is open outside of them
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "td", "th", "table"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "td", "th", "table"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "td", "th", "table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    **{t: (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])) for t in ("thead", "tbody", "tfoot")},
}
CELL_SHIELD = frozenset(["td", "th", "table"])
SHIELDED = frozenset(["table", "thead", "tbody", "tfoot", "tr", "td", "th"])


def walk(kinds: list[str], tags: list[str | None]) -> tuple[list[int], list[int], list[int]]:
    """For each token: owner (the element it opens, closes or lies in; ROOT for ignored end tags), parent (around the element it opens) and
    close (where an opened element ends: the place of the token that closed it, or the number of tokens)."""
    n = len(kinds)
    owner, parent, close = [ROOT] * n, [ROOT] * n, [n] * n
    stack: list[tuple[int, str]] = []
    count: dict[str, int] = {}

    def cut(names, shield, at: int) -> int:
        """Ends the innermost open element of these names, with all inside it, unless a shield stands before it."""
        if not any(count.get(x) for x in names):
            return ROOT
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][1] in names:
                found = stack[k][0]
                for place, tag in stack[k:]:
                    close[place] = at
                    count[tag] -= 1
                del stack[k:]
                return found
            if stack[k][1] in shield:
                return ROOT
        return ROOT

    for i, (kind, tag) in enumerate(zip(kinds, tags, strict=True)):
        if kind == "open" or kind == "void":
            if tag in PARAGRAPH_ENDS:
                cut(("p",), CELL_SHIELD, i)
                if tag in HEADINGS and stack and stack[-1][1] in HEADINGS:
                    cut((stack[-1][1],), CELL_SHIELD, i)
            elif tag in ENDS:
                cut(*ENDS[tag], i)
            owner[i], parent[i] = i, stack[-1][0] if stack else ROOT
            if kind == "void":
                close[i] = i
            else:
                stack.append((i, tag))
                count[tag] = count.get(tag, 0) + 1
        elif kind == "close":
            owner[i] = cut(HEADINGS if tag in HEADINGS else (tag,), () if tag in SHIELDED else CELL_SHIELD, i)
        else:
            owner[i] = stack[-1][0] if stack else ROOT
    return owner, parent, close


#: what an element is when its text is written as lines
FLOW, LINE, LIST, ITEM, TABLE, ROW, PRE, BOX, NOTICE, NONE = "flow", "line", "list", "item", "table", "row", "pre", "box", "notice", ""
BLOCKS = HEADINGS | frozenset("p ul ol li table blockquote pre div section article figure iframe video audio".split())
SILENT = frozenset(["hr", "style", "script", "img"])


def lines(kinds: list[str], tags: list[str | None], boxed: list[bool], owner: list[int], parent: list[int]) -> tuple[list[int | None], list[str]]:
    """For each token the place of the line its text belongs to (null: none), and for each start tag its role.

    A paragraph, heading, item, plain cell or element without blocks takes all text inside it; lists within an item are lines after it; text
    right in a container is a line up to the next element."""
    n = len(kinds)
    line, role = [None] * n, [NONE] * n
    holds = {parent[i] for i in range(n) if kinds[i] in ("open", "void") and tags[i] in BLOCKS}
    loose = None
    for i, (kind, tag) in enumerate(zip(kinds, tags, strict=True)):
        if kind == "open" or kind == "void":
            loose, up = None, parent[i]
            around = FLOW if up == ROOT else role[up]
            if around in (FLOW, BOX):
                if tag == "p" or tag in HEADINGS:
                    role[i] = LINE
                elif tag in ("ul", "ol"):
                    role[i] = LIST
                elif tag in ("table", "pre"):
                    role[i] = tag
                elif tag in fixed.EMBED_TAGS:
                    role[i] = NOTICE
                elif tag not in SILENT:
                    role[i] = BOX if boxed[i] else FLOW if tag == "blockquote" or i in holds else LINE
            elif around == ITEM and tag in ("ul", "ol"):
                role[i] = LIST
            elif around in (LINE, ITEM, PRE):
                role[i], line[i] = (around if around == PRE else LINE), line[up]
            elif around == LIST:
                role[i] = ITEM if tag == "li" else NONE
            elif around in (TABLE, ROW) and tag == "tr":
                role[i] = ROW
            elif around == TABLE:
                role[i] = TABLE if tag in ("thead", "tbody", "tfoot") else NONE
            elif around == ROW and tag in ("td", "th"):
                role[i] = FLOW if i in holds else LINE
            if role[i] in (LINE, ITEM, PRE) and line[i] is None:
                line[i] = i
        elif kind == "close":
            if owner[i] != ROOT:
                loose = None
        else:
            up = owner[i]
            around = FLOW if up == ROOT else role[up]
            if around in (FLOW, BOX):
                loose = line[i] = i if loose is None else loose
            elif around in (LINE, ITEM, PRE):
                line[i] = line[up]
    return line, role


#: what stands on a line: the text of its tokens, or what is said of one
TEXT, BOX_START, BOX_END, TABLE_START, NOTED = range(5)


def entries(kinds: list[str], tags: list[str | None], close: list[int], line: list[int | None], role: list[str]) -> list[tuple[int, int, int, int | None, bool, list[int]]]:
    """The lines of a document in order: (pos, sub, said, head, pre, parts), head being the start tag whose line it is, parts the tokens it is made of.

    Inner boxes that end with the same token come before outer ones, and before what the token starts."""
    out, at = [], {}
    for i, kind in enumerate(kinds):
        place = line[i]
        if place is not None:
            e = at.get(place)
            if e is None:
                e = at[place] = [place, 0, TEXT, None, False, []]
                out.append(e)
            if kind == "text" or kind == "bracket":
                e[5].append(i)
            elif place == i and kind != "close":
                e[3], e[4] = i, role[i] == PRE
        if role[i] == BOX:
            out += [[i, 0, BOX_START, None, False, [i]], [close[i], -1 - i, BOX_END, None, False, [i]]]
        elif role[i] == TABLE and tags[i] == "table":
            out.append([i, 0, TABLE_START, None, False, [i]])
        elif role[i] == NOTICE:
            out.append([i, 0, NOTED, None, False, [i]])
    return sorted(out, key=lambda e: (e[0], e[1]))


ENTRY = "pos int, sub int, said tinyint, head int, pre boolean, parts array<int>"


def _entries_of(kinds: pa.Array, tags: pa.Array, boxed: pa.Array) -> pa.Array:
    ends, rows = [0], []
    for kind, tag, box in zip(kinds, tags, boxed, strict=True):
        if kind.is_valid:
            kind, tag = kind.as_py(), tag.as_py()
            owner, parent, close = walk(kind, tag)
            line, role = lines(kind, tag, box.as_py(), owner, parent)
            rows += entries(kind, tag, close, line, role)
        ends.append(len(rows))
    types = [pa.int32(), pa.int32(), pa.int8(), pa.int32(), pa.bool_(), pa.list_(pa.int32())]
    cols = [pa.array([r[j] for r in rows], t) for j, t in enumerate(types)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(cols, names=[c.split()[0] for c in ENTRY.split(", ")]))


def _seen(docs: DataFrame, boxed) -> DataFrame:
    """The tokens of documents, with what the walk looks at."""
    def seen(tok: Column) -> Column:
        kind, tag = K.classify(tok)
        box = F.when(tok.startswith("<"), boxed(tok)).otherwise(False) if boxed else F.lit(False)
        return F.struct(kind.alias("kind"), tag.alias("tag"), box.alias("boxed"))

    toks = F.regexp_extract_all(K.clean_markup(F.col("html")), F.lit(K.TOKEN), F.lit(0))
    return docs.withColumn("toks", toks).drop("html").withColumn("seen", F.transform("toks", seen))


def document_lines(docs: DataFrame, boxed=None) -> DataFrame:
    """docs(doc_id, html, …) with toks, seen and the array `entries` of their lines in place of html, see `entries`; a row stays a row."""
    walked = F.arrow_udf(_entries_of, f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in ENTRY.split(', '))}>>")
    return _seen(docs, boxed).withColumn("entries", walked(F.col("seen.kind"), F.col("seen.tag"), F.col("seen.boxed")))


def element_tree(docs: DataFrame, boxed=None, placed: bool = False) -> DataFrame:
    """The token table of docs(doc_id, html) with owner, parent, close, line and role, see `walk` and `lines`.

    boxed: a test of a start tag (Column -> Column) for containers whose start and end are lines of their own."""
    base = _seen(K.by_doc(docs.select("doc_id", "html"), placed), boxed)
    made = "owner array<int>, parent array<int>, close array<int>, line array<int>, role array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.int32())] * 4 + [pa.list_(pa.string())]
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                seen = (b.column(2)[i].values if b.column(2)[i].is_valid else None)
                if seen is None:
                    rows.append(([],) * 5)
                    continue
                kind, tag, box = (seen.field(j).to_pylist() for j in range(3))
                owner, parent, close = walk(kind, tag)
                rows.append((owner, parent, close, *lines(kind, tag, box, owner, parent)))
            arrays = [pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=b.schema.names + [c.split()[0] for c in made.split(", ")])

    kind = base.schema["seen"].dataType.simpleString()
    rows = base.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toks array<string>, seen {kind}, {made}")
    flat = rows.select("doc_id", F.posexplode_outer(F.arrays_zip("toks", "seen", "owner", "parent", "close", "line", "role")).alias("pos", "x"))
    return flat.where("x is not null").select(
        "doc_id", "pos", F.col("x.toks").alias("tok"), "x.seen.kind", "x.seen.tag", "x.owner", "x.parent", "x.close", "x.line", "x.role")
