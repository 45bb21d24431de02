"""Line dedup that can be undone: exact reference counts of line keys, with sharded cuckoo filters of the repeated ones in front.

A line's key is the line without blanks (space, tab to carriage return) at both ends and with A-Z lowered; keys of at least
`MIN_CHARS` code points count. The index holds three tables in the shared folder: `refs` (which document holds which key, the
exact source), `counts` (documents and largest doc_id by key) and `filters` (per shard a cuckoo filter of the keys that are in
`MIN_DOCS` documents or more). `insert` and `delete` change all three; a filter only spares exact look-ups, it decides nothing.

Keys are carried as two 64-bit halves of a 128-bit hash.

Defined cases: a null or empty text is one empty line; a line repeated in one document counts once; rows with the same doc_id are
one document; a row without doc_id is no document: it counts nowhere and keeps its lines; an empty table gives no rows; other
columns are carried along, one named like an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, map_columns, stored, texts_of, tidy

MIN_CHARS, MIN_DOCS = 20, 3
SLOTS, KICKS = 4, 500
KEYS_A_SHARD = 1 << 18
#: filters of at most so many bytes in all are broadcast; larger ones meet their shard by a shuffle
BROADCAST_BYTES = 32 << 20
KEY = ["h1", "h2"]


def key_of(line: bytes) -> bytes | None:
    """The 16 bytes of a line's key, None if it is too short to count."""
    key = line.strip(BLANKS).lower()  # bytes.lower() changes A-Z alone
    if len(key) < MIN_CHARS or (not key.isascii() and len(key.decode()) < MIN_CHARS):
        return None
    return xxhash.xxh3_128_digest(key)


def line_refs(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, h1, h2: each key once a row of docs."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, counts = [], []
            for text in texts_of(b.column(1)):
                own = set(map(key_of, text.split(b"\n")))
                own.discard(None)
                keys += sorted(own)
                counts.append(len(own))
            if keys:
                halves = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
                ids = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), counts)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["doc_id", *KEY])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, h1 long, h2 long")


class Cuckoo:
    """A cuckoo filter: 16-bit fingerprints, four a bucket, two buckets a key. kept: fingerprints that found no room."""

    def __init__(self, keys: int):
        self.mask = (1 << max(int(keys / (SLOTS * 0.9)), 1).bit_length()) - 1
        self.table = np.zeros((self.mask + 1, SLOTS), dtype=np.uint16)
        self.kept: list[int] = []

    def places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (h2.astype(np.uint64) >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (h1.astype(np.uint64) & np.uint64(self.mask)).astype(np.int64)
        return mark, first, self.other(first, mark)

    def other(self, place, mark):
        return place ^ ((np.asarray(mark).astype(np.int64) * 0x5BD1) & self.mask)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> None:
        turn = 0
        for mark, a, b in zip(*(x.tolist() for x in self.places(h1, h2)), strict=True):
            place = a if not self.table[a].all() else b
            for _ in range(KICKS):
                row = self.table[place]
                free = np.flatnonzero(row == 0)
                if len(free):
                    row[free[0]] = mark
                    break
                turn += 1
                row[turn % SLOTS], mark = mark, int(row[turn % SLOTS])
                place = int(self.other(place, mark))
            else:
                self.kept.append(mark)

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        for mark, a, b in zip(*(x.tolist() for x in self.places(h1, h2)), strict=True):
            for place in (a, b):
                at = np.flatnonzero(self.table[place] == mark)
                if len(at):
                    self.table[place, at[0]] = 0
                    break
            else:
                if mark in self.kept:
                    self.kept.remove(mark)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        mark, a, b = self.places(h1, h2)
        found = (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)
        return found | np.isin(mark, self.kept) if self.kept else found

    def dumps(self) -> bytes:
        return len(self.kept).to_bytes(4, "little") + np.array(self.kept, dtype="<u2").tobytes() + self.table.astype("<u2").tobytes()

    @classmethod
    def loads(cls, data: bytes) -> Cuckoo:
        new, n = cls(0), int.from_bytes(data[:4], "little")
        new.kept = np.frombuffer(data, "<u2", n, 4).tolist()
        new.table = np.frombuffer(data, "<u2", offset=4 + 2 * n).reshape(-1, SLOTS).copy()
        new.mask = len(new.table) - 1
        return new


@dataclass
class Index:
    refs: DataFrame      # doc_id, h1, h2
    counts: DataFrame    # h1, h2, n_docs, last_doc
    filters: DataFrame   # shard, filter
    shards: int
    min_docs: int


def shard(shards: int):
    return F.pmod(F.col("h2"), F.lit(shards)).cast("int")


def count_refs(refs: DataFrame) -> DataFrame:
    """Exact documents and largest doc_id by key, summed before the shuffle."""
    return refs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


def build_filters(keys: DataFrame, shards: int) -> DataFrame:
    """keys(h1, h2) -> shard, filter. Each shard holds about KEYS_A_SHARD keys."""
    def build(key, group):
        made = Cuckoo(group.num_rows)
        made.insert(group.column("h1").to_numpy(), group.column("h2").to_numpy())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([made.dumps()], pa.binary())})

    return keys.select(shard(shards).alias("shard"), *KEY).groupBy("shard").applyInArrow(build, "shard int, filter binary")


def build(docs: DataFrame, min_docs: int = MIN_DOCS) -> Index:
    """docs(doc_id, text) -> the index of all their lines."""
    refs = line_refs(docs)
    ids = docs.agg(F.count("doc_id").alias("n"), F.countDistinct("doc_id").alias("d")).first()
    if ids["n"] != ids["d"]:  # rows with one doc_id are one document
        refs = refs.distinct()
    refs = stored(refs, "line-refs")
    counts = stored(count_refs(refs), "line-counts")
    hot = counts.where(F.col("n_docs") >= min_docs)
    shards = max(1, -(-hot.count() // KEYS_A_SHARD))
    return Index(refs, counts, stored(build_filters(hot, shards), "line-filters"), shards, min_docs)


def changed(index: Index, refs: DataFrame, sign: int) -> Index:
    """The index after adding (1) or taking away (-1) refs. Counts are exact: keys the change touches are counted again."""
    now = index.refs.unionByName(refs).distinct() if sign > 0 else index.refs.join(refs.select("doc_id").distinct(), "doc_id", "left_anti")
    now = stored(now.select("doc_id", *KEY), "line-refs")
    touched = refs.select(*KEY).distinct()
    again = count_refs(now.join(touched, KEY, "left_semi"))
    counts = stored(index.counts.join(touched, KEY, "left_anti").unionByName(again), "line-counts")
    is_hot = F.coalesce(F.col("n_docs") >= index.min_docs, F.lit(False))
    old = index.counts.join(touched, KEY, "left_semi").select(*KEY, is_hot.alias("was"))
    new = again.select(*KEY, is_hot.alias("is"))
    moves = old.join(new, KEY, "full").select(
        shard(index.shards).alias("shard"), *KEY, F.coalesce("was", F.lit(False)).alias("was"), F.coalesce("is", F.lit(False)).alias("is"))
    moves = moves.where(F.col("was") != F.col("is")).select("shard", *KEY, F.col("is").alias("add"))

    def update(filters, group):
        made = Cuckoo.loads(filters.column("filter")[0].as_py()) if filters.num_rows else Cuckoo(group.num_rows)
        h1, h2 = group.column("h1").to_numpy(), group.column("h2").to_numpy()
        add = group.column("add").to_numpy(zero_copy_only=False)
        made.delete(h1[~add], h2[~add])
        made.insert(h1[add], h2[add])
        where = (filters if filters.num_rows else group).column("shard")[:1]
        return pa.table({"shard": where, "filter": pa.array([made.dumps()], pa.binary())})

    filters = index.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInArrow(update, "shard int, filter binary")
    return replace(index, refs=now, counts=counts, filters=stored(filters, "line-filters"))


def insert(index: Index, docs: DataFrame) -> Index:
    return changed(index, stored(line_refs(docs).distinct(), "line-refs"), 1)


def delete(index: Index, doc_ids: DataFrame) -> Index:
    """doc_ids(doc_id): the documents to take away."""
    gone = index.refs.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return changed(index, stored(gone.select("doc_id", *KEY), "line-refs"), -1)


def repeated(index: Index) -> DataFrame:
    """doc_id, h1, h2: the lines each document loses. The filters pass refs whose key may be repeated; the counts decide."""
    shards = index.shards

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, h1, h2 = (np.ascontiguousarray(b.column(i).to_numpy(zero_copy_only=False), dtype="<i8") for i in range(3))
            of = np.mod(h2, shards)
            groups = [np.flatnonzero(of == s) for s in np.unique(of)]
            blocks = [np.stack([ids[g], h1[g], h2[g]]).tobytes() for g in groups]
            yield pa.RecordBatch.from_arrays([pa.array([of[g[0]] for g in groups], pa.int32()), pa.array(blocks, pa.binary())], names=["shard", "block"])

    @tidy
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, h1, h2 = np.frombuffer(block, dtype="<i8").reshape(3, -1)
                held = Cuckoo.loads(data).holds(h1, h2)
                if held.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[held]) for x in (ids, h1, h2)], names=["doc_id", *KEY])

    filters = index.filters
    if filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        filters = F.broadcast(filters)
    blocks = index.refs.select("doc_id", *KEY).mapInArrow(pack, "shard int, block binary")
    maybe = blocks.join(filters, "shard").select("block", "filter").mapInArrow(probe, "doc_id long, h1 long, h2 long")
    hot = index.counts.where(F.col("n_docs") >= index.min_docs)
    return maybe.join(hot, KEY).where(F.col("doc_id") != F.col("last_doc")).select("doc_id", *KEY)


def apply(docs: DataFrame, index: Index) -> DataFrame:
    """docs with text replaced by the lines that stay, and n_lines and n_dropped (long)."""
    stay = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    drops = repeated(index).groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct(*KEY)).alias("drops"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in stay]).alias("row"), F.col("doc_id").alias("id"), "text").join(drops, "id", "left")

    def cut(batch: pa.RecordBatch):
        named = lambda n: batch.column(batch.schema.get_field_index(n))
        drops = named("drops")
        starts, halves = drops.offsets.to_numpy(), drops.values
        pairs = np.stack([halves.field(0).to_numpy(zero_copy_only=False), halves.field(1).to_numpy(zero_copy_only=False)], 1).astype("<i8")
        kept, n_lines, n_dropped = [], [], []
        for i, text in enumerate(texts_of(named("text"))):
            a, b = starts[i], starts[i + 1]
            if a == b:
                n_lines.append(text.count(b"\n") + 1)
                n_dropped.append(0)
                kept.append(text)
                continue
            gone, lines = {row.tobytes() for row in pairs[a:b]}, text.split(b"\n")
            stay = [x for x in lines if key_of(x) not in gone]
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
            kept.append(b"\n".join(stay))
        return [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]

    made = [("text", "string"), ("n_lines", "long"), ("n_dropped", "long")]
    return map_columns(rows, made, cut, keep=["row"], need=["text", "drops"]).select("row.*", *[n for n, _ in made])
