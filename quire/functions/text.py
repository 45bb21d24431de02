"""Text functions: every one maps Columns to a Column and stays inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from ..fixed import WS

_ACCENTED, _PLAIN = fixed.accent_table()
_TAG = r"<[^>]+>"
# white space as in WS, with printable ASCII ruled out first, and runs of it other than one blank
_WIDE = rf"[\x00-\x20\x7F-\x{{10FFFF}}&&{WS}]"
_RUN = rf" {_WIDE}+|[\x00-\x1F\x7F-\x{{10FFFF}}&&{WS}]{_WIDE}*"
_NBSP = r"(?i)&nbsp;"


def swap(c: Column, *pairs: tuple[str, str]) -> Column:
    """Literal replacements, applied in the given order."""
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, c)


def let(value: Column, fn) -> Column:
    """fn(value) with `value` computed once, however often `fn` reads it. Keeps plans small
    and expensive values out of inner loops."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def escape_text(c: Column) -> Column:
    return swap(c, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def escape_xml(c: Column) -> Column:
    return swap(escape_text(c), ("'", "&#39;"))


def unescape_basic(c: Column) -> Column:
    return swap(c, ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def code_point(n: Column) -> Column:
    """The one-character string of a code point (`chr` stops at 255)."""
    return F.decode(F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0")), "UTF-32")


def unescape_xml(c: Column) -> Column:
    """Numeric references first, then the named five with the ampersand last."""
    def one(t: Column) -> Column:
        hexa = F.regexp_extract(t, r"^&#[xX]([0-9a-fA-F]+);$", 1)
        deci = F.regexp_extract(t, r"^&#(\d+);$", 1)
        return (F.when(hexa != "", code_point(F.conv(hexa, 16, 10)))
                .when(deci != "", code_point(deci.cast("bigint"))).otherwise(t))
    toks = F.regexp_extract_all(c, F.lit(r"&#[xX][0-9a-fA-F]+;|&#\d+;|[^&]+|&"), F.lit(0))
    numeric = F.when(c.contains("&#"), F.array_join(F.transform(toks, one), "")).otherwise(c)
    return swap(numeric, ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def collapse(c: Column) -> Column:
    """White-space runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, _RUN, " "))


normalize_text = collapse


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_WIDE}+|{_WIDE}+$", "")


def is_blank(c: Column) -> Column:
    """Whether nothing is left of a text without its white space."""
    return ~c.rlike(rf"(?s)(?!{WS}).")


def strip_diacritics(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"[\x{0300}-\x{036F}]", "")


def normalize_label(c: Column) -> Column:
    return strip_diacritics(F.lower(strip(c)))


def normalize_tag(c: Column) -> Column:
    lowered = strip_diacritics(F.lower(F.translate(c, "ºª", "oa")))
    return F.regexp_replace(lowered, "[^a-z0-9]", "")


def normalize_title(c: Column) -> Column:
    return collapse(F.lower(strip_diacritics(c)))


def slug(c: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.lower(strip_diacritics(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def blank_to(c: Column, default: Column | str) -> Column:
    d = default if isinstance(default, Column) else F.lit(default)
    return F.when(c.isNull() | (c == ""), d).otherwise(c)


def stem(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\.[^.]+$", ""))


def document_title(filename: Column, description: Column,
                   generators: list[str] = fixed.GENERATOR_DESCRIPTIONS) -> Column:
    """struct(title, source): a written description wins unless a generator wrote it."""
    written = strip(F.coalesce(description, F.lit("")))
    by_hand = (written != "") & ~collapse(F.lower(written)).isin(generators)
    return F.struct(
        F.when(by_hand, written).otherwise(blank_to(stem(filename), fixed.DEFAULT_DOC_TITLE)).alias("title"),
        F.when(by_hand, "description").otherwise("filename").alias("source"))


def title_scale(title: Column, comfortable: int) -> Column:
    n = F.length(strip(title))
    return (F.when(n <= comfortable, F.lit(1.0))
            .otherwise(F.greatest(F.lit(0.4), F.round(F.sqrt(F.lit(float(comfortable)) / n), 2))))


def untagged(c: Column) -> Column:
    """Tags and non-breaking blanks to blanks, collapsed."""
    return collapse(F.regexp_replace(F.regexp_replace(c, _TAG, " "), _NBSP, " "))


def context_after(after: Column, limit: int = 60) -> Column:
    return let(untagged(F.substring(after, 1, 400)), lambda t: F.when(
        F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit)), F.lit("…"))).otherwise(t))


def context_before(before: Column, limit: int = 60) -> Column:
    return let(untagged(F.right(before, F.lit(400))), lambda t: F.when(
        F.length(t) > limit, F.concat(F.lit("…"), F.ltrim(F.right(t, F.lit(limit))))).otherwise(t))


def heading_text(inner: Column) -> Column:
    return F.substring(untagged(inner), 1, 60)


def truncate(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit,
                  F.concat(F.rtrim(F.substring(c, 1, max(1, limit - 1))), F.lit("…"))).otherwise(c)


def plain_text(c: Column) -> Column:
    bare = F.when(c.contains("<"), F.regexp_replace(c, _TAG, "")).otherwise(c)
    read = swap(F.regexp_replace(bare, r"(?i)&nbsp;|&#160;|&#xa0;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
    return collapse(F.when(c.contains("&"), read).otherwise(bare))


def has_content(html: Column) -> Column:
    return (plain_text(html) != "") | html.rlike(r"(?i)<(img|table|iframe|video)\b")


def without_code(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(pre|code)\b[^>]*>.*?</\1>", "")


def upper_h2(html: Column) -> Column:
    """Upper-case the text runs of level-2 headings, never their tags or entities."""
    runs = r"<[^>]*>|&[a-zA-Z][a-zA-Z0-9]*;|&#\d+;|[^<&]+|[<&]"

    def up(inner: Column) -> Column:
        return F.array_join(F.transform(
            F.regexp_extract_all(inner, F.lit(runs), F.lit(0)),
            lambda t: F.when(t.rlike("^[<&]"), t).otherwise(F.upper(t))), "")

    def part(p: Column) -> Column:
        head = F.regexp_extract(p, r"(?is)^(.*?<h2[^>]*>)", 1)
        return F.when(head == "", p).otherwise(
            F.concat(head, up(F.substring(p, F.length(head) + 1, F.length(p)))))

    parts = F.split(html, r"(?i)</h2>")
    last = F.size(parts) - 1
    done = F.concat(F.transform(F.slice(parts, F.lit(1), last), part),
                    F.slice(parts, F.size(parts), F.lit(1)))
    return F.when(html.rlike(r"(?i)<h2"), F.array_join(done, "</h2>")).otherwise(html)


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units, eight hex digits."""
    def units(ch: Column) -> Column:
        cp = F.ascii(ch).cast("bigint")
        rest = cp - 0x10000
        return F.when(cp > 0xFFFF, F.array(F.lit(0xD800).cast("bigint") + F.shiftright(rest, 10),
                                           F.lit(0xDC00).cast("bigint") + rest.bitwiseAND(F.lit(0x3FF).cast("bigint")))
                      ).otherwise(F.array(cp))
    codes = F.flatten(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), units))
    h = F.aggregate(codes, F.lit(2166136261).cast("bigint"),
                    lambda acc, u: (acc.bitwiseXOR(u) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295)))
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def resource_name(src: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(src, r"^\.?/*", ""), r"(?i)^resources/", "")
    base = F.element_at(F.split(bare, "/"), -1)
    # '+' is data in a path; keep it through the form decoder
    return F.coalesce(F.try_url_decode(F.replace(base, F.lit("+"), F.lit("%2B"))), base)


def video_link(src: Column) -> Column:
    vid = F.regexp_extract(src, r"(?i)youtube(?:-nocookie)?\.com/embed/([^?&\"]+)", 1)
    return F.when(vid != "", F.concat(F.lit("https://www.youtube.com/watch?v="), vid)).otherwise(src)


def next_version(published: Column, local: Column) -> Column:
    return F.greatest(F.coalesce(published, F.lit(0)), F.coalesce(local, F.lit(0))) + 1


def set_version(xml: Column, version: Column) -> Column:
    tagged = F.concat(F.lit("<version>"), version.cast("string"), F.lit("</version>"))
    has = xml.rlike(r"(?i)<version>\s*\d+\s*</version>")
    return (F.when(has, F.regexp_replace(xml, F.lit(r"(?i)<version>\s*\d+\s*</version>"), tagged))
            .otherwise(F.regexp_replace(xml, F.lit(r"(?i)(<theme>\s*)"),
                                        F.concat(F.lit("$1"), tagged, F.lit("\n    ")))))


def depth_tag(depth: Column) -> Column:
    return F.when(depth <= 0, "").when(depth == 1, " [Subpágina]").otherwise(" [3er nivel]")


def attr(tag: Column, name: str) -> Column:
    """Attribute value of an opening tag, null when the attribute is absent."""
    raw = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    def bare(r: Column) -> Column:
        return F.when(r.startswith('"') | r.startswith("'"), F.substring(r, F.lit(2), F.length(r) - 2)).otherwise(r)
    return let(raw, lambda r: F.when(r != "", F.when(r.contains("&"), let(bare(r), unescape_xml)).otherwise(bare(r))))


def has_attr(tag: Column, name: str) -> Column:
    return tag.rlike(rf"(?is)\s{name}(?:[\s=>/]|$)")
