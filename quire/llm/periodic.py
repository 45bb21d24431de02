"""Periodic runs of words by Baier grouping.

A run is a stretch of consecutive words with smallest period q and at least max(12, 2q) words that no neighbouring word extends.
Every run has, in one of two opposite orders of its words, a Lyndon root: the longest Lyndon word that starts at some place of it. So it
is enough to know the longest Lyndon word from every place in both orders, and to extend each as a period to both sides.

Phase one of Baier's suffix sorter gives just these lengths. Suffixes are grouped by their first word. Groups are taken from the
greatest to the least; each member hands its text to the nearest place before it that still waits in a lower group, and places that
received the same number of copies leave their group for a new one just above it. The text gathered at a place is its longest
Lyndon word. Taken members leave a linked list of places, so the nearest waiting place is the list's left neighbour, in constant time.

How far a period reaches is read off names of stretches of 2^k words: two stretches have one name if their words are the same. Only
stretches that occur twice get a name, so text without repeats needs few levels. Names are exact, not hashes. The same names tell which
words lie in a passage that its document holds twice; no other word can be in a run (see runs_of), so grouping works on these passages.

A document is one row and no row needs another, so nothing is shuffled. A task holds a slice of about SLICE_WORDS words at a time, or
one document where that is longer; memory and time grow in proportion to it (levels: the logarithm of its longest repeat).

Defined cases: a null, empty or blank text has no words and no runs; repeated rows and ids are documents of their own; texts are
processed whole, whatever their length; an empty table gives no rows; other columns stay, but for one of a made column's name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy

SHORTEST = 12
SLICE_WORDS = 1 << 18
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def words_of(text: bytes | None) -> list[bytes]:
    """Words between blanks of ASCII, as UTF-8 bytes."""
    return text.split() if text else []


def lyndon_lengths(first: list[list[int]], home: list[int]) -> list[int]:
    """first: the places of each symbol, ascending, symbols from the least to the greatest; places count from 1. home[i]: the symbol
    at place i, home[0] any. Returns the length of the longest Lyndon word from each place (index 0: nothing)."""
    n, k = len(home) - 1, len(first)
    left, right, length = list(range(-1, n + 1)), list(range(1, n + 3)), [1] * (n + 1)
    members, home = list(first), list(home)
    below, above = list(range(-1, k - 1)), list(range(1, k + 1))
    group = k - 1
    while group >= 0:
        live = [i for i in members[group] if home[i] == group]
        if len(live) == 1:
            i = live[0]
            p, q = left[i], right[i]
            left[q], right[p] = p, q
            if p:
                length[p] += length[i]
                old, new = home[p], len(members)
                over = above[old]
                members.append(live := [p])
                below.append(old)
                above.append(over)
                below[over] = above[old] = home[p] = new
        elif live:
            step, last, copies, moved = length[live[0]], 0, 0, {}
            for i in live:
                p, q = left[i], right[i]
                left[q], right[p] = p, q
                if p == last:
                    copies += 1
                    continue
                if last:
                    moved.setdefault((copies, home[last]), []).append(last)
                last, copies = p, 1
            if last:
                moved.setdefault((copies, home[last]), []).append(last)
            # within one old group more copies stand higher: each new group goes right above the old one, most copies first
            for copies, old in sorted(moved, reverse=True) if len(moved) > 1 else moved:
                places, new = moved[copies, old], len(members)
                for p in places:
                    length[p] += copies * step
                    home[p] = new
                over = above[old]
                members.append(places)
                below.append(old)
                above.append(over)
                below[over] = above[old] = new
        group = below[group]
    return length


def both_orders(symbols: list[int], kinds: int) -> tuple[list[int], list[int]]:
    """Lyndon lengths of a sequence of symbols 0..kinds-1 in their order and in the opposite one."""
    first: list[list[int]] = [[] for _ in range(kinds)]
    for i, s in enumerate(symbols, 1):
        first[s].append(i)
    up = lyndon_lengths(first, [0, *symbols])
    down = lyndon_lengths(first[::-1], [0, *[kinds - 1 - s for s in symbols]])
    return up[1:], down[1:]


def names_once_longer(now: np.ndarray, at: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The places whose stretch, made of the named ones at a place and `gap` later, occurs twice; with the stretches' names."""
    at = at[at + gap < len(now)]
    at = at[(now[at] >= 0) & (now[at + gap] >= 0)]
    _, name, count = np.unique(now[at] * (now.max(initial=0) + 1) + now[at + gap], return_inverse=True, return_counts=True)
    twice = count[name] > 1
    return at[twice], name[twice]


class Names:
    """Names of the stretches of 2^k symbols, k up to `top`. Stretches that occur once have a name of their own, a negative one."""

    def __init__(self, symbols: np.ndarray, top: int = 63):
        at = np.arange(len(symbols))
        self.own, self.levels = -1 - at, [symbols]
        while len(self.levels) <= top:
            at, name = names_once_longer(self.levels[-1], at, 1 << (len(self.levels) - 1))
            if not len(at):
                return
            level = self.own.copy()
            level[at] = name
            self.levels.append(level)

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from places a and b on are the same."""
        start, a, b, last = a, a.copy(), b.copy(), len(self.own) - 1
        for k in reversed(range(len(self.levels))):
            same = self.levels[k][np.minimum(a, last)] == self.levels[k][np.minimum(b, last)]
            a += same << k
            b += same << k
        return a - start

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols right before places a and b are the same."""
        start, a, b = a, a.copy(), b.copy()
        for k in reversed(range(len(self.levels))):
            x, y = a - (1 << k), b - (1 << k)
            same = (x >= 0) & (self.levels[k][np.maximum(x, 0)] == self.levels[k][np.maximum(y, 0)])
            a -= same << k
            b -= same << k
        return start - a


def repeated(text: np.ndarray, doc: np.ndarray, m: int) -> np.ndarray:
    """Which places lie in a stretch of m symbols that occurs twice in its document."""
    k = m.bit_length() - 1
    names = Names(text, k)
    hit = np.zeros(len(text) + 1, dtype=np.int64)
    if len(names.levels) > k:
        at, name = names_once_longer(names.levels[k], np.flatnonzero(names.levels[k] >= 0), m - (1 << k))
        _, same, count = np.unique(name * (doc[-1] + 1) + doc[at], return_inverse=True, return_counts=True)
        at = at[count[same] > 1]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + m, -1)
    return np.cumsum(hit[:-1]) > 0


def joined(parts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All parts in one array, each ended by a symbol of its own, and where each part starts."""
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
    text = np.zeros(ends[-1] if parts else 0, dtype=np.int64)
    body = np.ones(len(text), dtype=bool)
    body[ends - 1] = False
    text[body] = np.fromiter((s for p in parts for s in p), dtype=np.int64, count=len(text) - len(parts)) + len(parts)
    text[~body] = np.arange(len(parts))
    return text, ends - [len(p) + 1 for p in parts]


def runs_of(docs: list[list[bytes]], shortest: int = SHORTEST) -> tuple[np.ndarray, ...]:
    """The runs of all documents as arrays (document, start, length, period), in this order.

    A run of period q repeats at least max(q, shortest - q) words q places later, so each of its words lies in a stretch of at least
    shortest / 2 words that its document holds twice. Words elsewhere are in no run and end the stretches that are grouped."""
    ids: dict[bytes, int] = {}
    coded = [[ids.setdefault(w, len(ids)) for w in words] for words in docs]
    text, begin = joined(coded)
    none = (np.zeros(0, dtype=np.int64),) * 4
    if not len(text):
        return none
    doc = np.repeat(np.arange(len(docs)), [len(c) + 1 for c in coded])
    edge = np.diff(repeated(text, doc, max(1, (shortest + 1) // 2)).astype(np.int8), prepend=0, append=0)
    spans = list(zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist(), strict=True))
    if not spans:
        return none
    stretches, grown = [], []
    for low, high in spans:
        part = text[low:high].tolist()
        rank = {s: i for i, s in enumerate(dict.fromkeys(part))}
        stretches.append([rank[s] for s in part])
        grown.append(both_orders(stretches[-1], len(rank)))
    symbols, first = joined(stretches)
    place = np.concatenate([np.arange(f, f + len(s)) for f, s in zip(first.tolist(), stretches, strict=True)] * 2)
    period = np.concatenate([np.array(g[o], dtype=np.int64) for o in (0, 1) for g in grown])
    # a run holds a root that starts within its first period, so the word one period later is in the run too and the same
    root = symbols[place] == symbols[place + period]
    place, period = place[root], period[root]
    names = Names(symbols)
    low = place - names.before(place, place + period)
    length = place + period + names.after(place, place + period) - low
    good = length >= np.maximum(shortest, 2 * period)
    part = np.searchsorted(first, low[good], side="right") - 1
    low = low[good] - first[part] + np.array([s for s, _ in spans], dtype=np.int64)[part]
    found = np.unique(np.stack([low, period[good], length[good]], 1), axis=0)
    return doc[found[:, 0]], found[:, 0] - begin[doc[found[:, 0]]], found[:, 2], found[:, 1]


def slices(batch: pa.RecordBatch, split: Callable[[dict], list[bytes]]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Rows of a batch from a place on, with their words, about SLICE_WORDS together."""
    first, held, size = 0, [], 0
    for i in range(batch.num_rows):
        words = split({n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)})
        if held and size + len(words) > SLICE_WORDS:
            yield first, held
            first, held, size = i, [], 0
        held.append(words)
        size += len(words)
    if held:
        yield first, held


def find(docs: DataFrame, shortest: int = SHORTEST, words: Callable[[dict], list[bytes]] | None = None) -> DataFrame:
    """docs(text, ...) with runs (array of start, length, period by start, then period), n_words, and collapsed: the words outside every
    run's repeats, the ones after its first period, joined by single spaces. words: gets a row as dict, the text as bytes, and gives its words; the
    words of `text` if not given."""
    split = words or (lambda row: words_of(row["text"]))
    made = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T._parse_datatype_string(RUNS)),
                         T.StructField("collapsed", T.StringType())])
    stay = [f for f in docs.schema.fields if f.name not in ("text", *made.names)]
    if any(f.name != "text" and f.name in made.names for f in docs.schema.fields):
        docs = docs.drop(*made.names)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in slices(b, split):
                doc, start, length, period = runs_of(texts, shortest)
                count = np.bincount(doc, minlength=len(texts))
                ends = np.concatenate(([0], np.cumsum(count)))
                collapsed = []
                for d, w in enumerate(texts):
                    here = slice(ends[d], ends[d + 1])
                    if count[d]:
                        change = np.zeros(len(w) + 1, dtype=np.int64)
                        np.add.at(change, start[here] + period[here], 1)
                        np.add.at(change, start[here] + length[here], -1)
                        w = [w[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]
                    collapsed.append(b" ".join(w))
                items = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], names=["start", "length", "period"])
                arrays = [b.column(b.schema.get_field_index(f.name)).slice(first, len(texts)) for f in stay]
                arrays += [pa.array([len(w) for w in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items),
                           pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in stay] + made.names)

    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, T.StructType(stay + made.fields))
