"""Image and binary functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import let

DATA_URL = r"data:image/([a-zA-Z0-9+.-]+);base64,([A-Za-z0-9+/=]+)"


def lookup(key: Column, table: dict[str, str]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(m, key)


def image_ext(subtype: Column) -> Column:
    return F.coalesce(lookup(F.lower(subtype), fixed.IMAGE_EXT), F.lit("png"))


def word_image_ext(ext: Column) -> Column:
    return lookup(F.lower(ext), fixed.WORD_IMAGE_EXT)


def data_url(subtype: Column, content: Column) -> Column:
    return F.concat(F.lit("data:image/"), subtype, F.lit(";base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def data_url_subtype(url: Column) -> Column:
    return F.regexp_extract(url, DATA_URL, 1)


def data_url_bytes(url: Column) -> Column:
    return F.try_to_binary(F.regexp_extract(url, DATA_URL, 2), F.lit("base64"))


def _uint(b: Column, start: int, n: int, little: bool = False) -> Column:
    cuts = [F.substring(b, start + i, 1) for i in range(n)]
    raw = F.concat(*reversed(cuts)) if little else F.substring(b, start, n)
    return F.conv(F.hex(raw), 16, 10).cast("bigint")


def _jpeg(content: Column, scan: int | None) -> Column:
    """Walk the segments of the first `scan` bytes (None: of all) to the frame header.

    Each fold step jumps to the next 0xFF byte or over one segment, so the number of
    0xFF bytes bounds the steps.
    """
    # ".FF.D8.." keeps byte borders visible, so a search never straddles two bytes
    return let(F.regexp_replace(F.hex(content if scan is None else F.substring(content, 1, scan)), "(..)", ".$1"), _jpeg_frame)


def _jpeg_frame(hx: Column) -> Column:
    n = F.length(hx) / 3

    def byte(off: Column, k: int) -> Column:
        return F.conv(F.substring(hx, ((off + k) * 3 + 2).cast("int"), F.lit(2)), 16, 10).cast("int")

    def next_ff(off: Column) -> Column:
        rest = F.substring(hx, (off * 3 + 1).cast("int"), F.length(hx))
        at = F.instr(rest, ".FF")
        return F.when(at > 0, off + (at - 1) / 3).otherwise(n)

    empty = F.struct(F.lit(2).alias("off"), F.lit(None).cast("int").alias("w"),
                     F.lit(None).cast("int").alias("h"), F.lit(False).alias("done"))

    def state(off: Column, w: Column, h: Column, done: Column) -> Column:
        return F.struct(off.cast("int").alias("off"), w.cast("int").alias("w"),
                        h.cast("int").alias("h"), done.alias("done"))

    def step(s: Column, _i: Column) -> Column:
        off, null = s["off"], F.lit(None)
        m = byte(off, 1)
        frame = (m >= 0xC0) & (m <= 0xCF) & ~m.isin(0xC4, 0xC8, 0xCC)
        return (F.when(s["done"], s)
                .when(off + 9 >= n, state(off, null, null, F.lit(True)))
                .when(byte(off, 0) != 0xFF, state(next_ff(off), null, null, F.lit(False)))
                .when(frame, state(off, byte(off, 7) * 256 + byte(off, 8),
                                   byte(off, 5) * 256 + byte(off, 6), F.lit(True)))
                .otherwise(state(off + 2 + byte(off, 2) * 256 + byte(off, 3), null, null, F.lit(False))))

    steps = F.greatest(F.lit(1), 2 * (F.size(F.split(hx, r"\.FF")) - 1) + 1).cast("int")
    end = F.aggregate(F.sequence(F.lit(1), steps), empty, step)
    return F.when(end["w"].isNotNull(), F.struct(end["w"].cast("bigint").alias("width"), end["h"].cast("bigint").alias("height")))


def image_size(content: Column, kind: Column, scan: int | None = None) -> Column:
    """struct(width, height) from the header bytes, null when they say nothing. `scan` bounds
    how far a JPEG is searched for its frame header; by default all of it is."""
    return let(F.struct(content.alias("c"), kind.alias("k")), lambda x: _image_size(x["c"], x["k"], scan))


def _image_size(content: Column, kind: Column, scan: int | None) -> Column:
    def size(w: Column, h: Column) -> Column:
        return F.struct(w.alias("width"), h.alias("height"))
    n = F.length(content)
    bmp_h = _uint(content, 23, 4, little=True)
    signed = F.when(bmp_h > 2147483647, F.lit(4294967296) - bmp_h).otherwise(bmp_h)
    return (F.when((kind == "png") & (n >= 24), size(_uint(content, 17, 4), _uint(content, 21, 4)))
            .when((kind == "gif") & (n >= 10), size(_uint(content, 7, 2, True), _uint(content, 9, 2, True)))
            .when((kind == "bmp") & (n >= 26), size(_uint(content, 19, 4, True), signed))
            .when(kind == "jpg", _jpeg(content, scan)))


def data_url_size(url: Column, scan: int | None = 65536) -> Column:
    """Size of an embedded image. The format looks for a JPEG frame in the first 64 KB only here."""
    return let(url, lambda u: image_size(data_url_bytes(u), word_image_ext(data_url_subtype(u)), scan))


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("bigint")


def fit_width(attr_w: Column, attr_h: Column, sniff_w: Column, sniff_h: Column, limit: int = 600) -> Column:
    """Display size: both attributes, else the header, else 400x300; capped in width."""
    given = F.coalesce((attr_w > 0) & (attr_h > 0), F.lit(False))
    known = sniff_w.isNotNull() & sniff_h.isNotNull()
    w = F.when(given, attr_w).when(known, sniff_w).otherwise(F.lit(400)).cast("bigint")
    h = F.when(given, attr_h).when(known, sniff_h).otherwise(F.lit(300)).cast("bigint")
    scaled = F.greatest(F.lit(1).cast("bigint"), half_up(h * limit / w))
    return F.struct(F.when(w > limit, F.lit(limit).cast("bigint")).otherwise(w).alias("width"),
                    F.when(w > limit, scaled).otherwise(h).alias("height"))


def print_scale(w: Column, h: Column, max_w: int = 2000, max_h: int = 2800) -> Column:
    return F.least(F.lit(1.0), F.lit(float(max_w)) / w, F.lit(float(max_h)) / h)
