"""Near-duplicates by SetSketch: documents whose sets of word shingles have a Jaccard similarity of at least a threshold are linked.

1. Every document gets its set of shingle hashes, a fingerprint of that set and a SetSketch: per register the smallest of its
   shingles' exponential values, written as a truncated exponent. Registers merge by maximum and agree about as often as the sets do.
2. Documents with one fingerprint are copies and become one representative. It goes by a number of the set, a hash of the
   fingerprint that no other set has; ids come back when components are formed: sets that share an id are linked.
3. Bands of registers put representatives into buckets. A bucket does not emit its pairs: each member is compared with the bucket's
   hub, the member that shares most places with others. The sets themselves confirm links; links are contracted to components.
4. What is left are buckets that still hold several components. Their members outside the largest component meet all others in
   blocks. A pair is passed on unless it is out of reach: by the bound that both overlaps with the hub put on it, or by a
   likelihood estimate from both sketches that lies `MARGIN` standard deviations below the threshold. Passed pairs are confirmed
   on the sets as well, and components are contracted once more.

A pair at the threshold shares no bucket with probability (1 - t^ROWS)^BANDS, 5e-8 at 0.8.

Words: A-Z lowered, maximal runs without blanks (space, tab to carriage return). Shingles: `width` words; fewer words are one shingle.

Defined cases: null, empty and blank texts have no shingles, are linked with nothing and stand for themselves; repeated rows with
one doc_id are one document only if their texts are equal, else the id stands for all its rows; a null doc_id takes no part and
gets a null component; very long texts are handled whole; other columns of the input are left to the caller's join on doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, texts_of, tidy

BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65_534
MARGIN = 4.5
BLOCK = 256
#: a list of at most so many ids (16 MB) is broadcast; a longer one is shuffled
BROADCAST_IDS = 1 << 20
_mix = np.random.default_rng(20_240_607)
FACTORS = (_mix.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
SALTS = _mix.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
BAND_FACTORS = (_mix.integers(0, 1 << 63, ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingles(text: bytes, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = text.lower().split()  # of bytes: A-Z alone, and exactly the six blanks
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n, out = len(h) - width + 1, np.zeros(len(h) - width + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = (out ^ h[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers: the smallest of independent exponential values, as a truncated power of the base. The smallest value
    belongs to the smallest uniform, so the logarithm is taken once a register."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 1024):
            part = (hashes[at:at + 1024, None] ^ SALTS) * FACTORS
            part ^= part >> np.uint64(32)
            part *= np.uint64(0xD6E8FEB86659FD93)
            least = np.minimum(least, part.min(0))
    value = -np.log1p(-((least >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def bands(registers: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = registers.reshape(BANDS, ROWS).astype(np.uint64)
        out = np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(ROWS):
            out = (out ^ mixed[:, k]) * BAND_FACTORS[k]
            out ^= out >> np.uint64(31)
    return out.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of most likelihood given how many registers of a are larger, smaller and equal, for pairs of rows."""
    more, less = (a > b).sum(-1), (a < b).sum(-1)
    same = a.shape[-1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def p(x):  # that one register exceeds the other, x: the share of the union that only the one set holds
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        up, down = np.clip(p(u - v * j), 1e-9, 1), np.clip(p(v - u * j), 1e-9, 1)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-9, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):
        one, two = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(one) > likelihood(two)
        low, high = np.where(left, low, one), np.where(left, two, high)
    return (low + high) / 2


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, fp1, fp2 (of the set), registers."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, prints, registers = [], [], []
            for text in texts_of(b.column(1)):
                own = shingles(text, width)
                n.append(len(own))
                prints.append(xxhash.xxh3_128_digest(own.tobytes()))
                registers.append(sketch(own).tobytes() if len(own) else b"")
            halves = np.frombuffer(b"".join(prints), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(registers, pa.binary())],
                names=["doc_id", "n_shingles", "fp1", "fp2", "registers"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, fp1 long, fp2 long, registers binary")


def number(salt: int) -> Column:
    """The number of a set."""
    return F.xxhash64("fp1", "fp2", "n_shingles", F.lit(salt))


def places(reps: DataFrame) -> DataFrame:
    """reps(doc, registers) -> band, place, doc: the buckets a document lies in."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = np.concatenate([bands(np.frombuffer(r, "<u2")) for r in b.column(1).to_pylist()])
                docs = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), BANDS)))
                band = np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(keys), docs], names=["band", "place", "doc"])

    return reps.select("doc", "registers").mapInArrow(run, "band int, place long, doc long")


def shared_buckets(reps: DataFrame) -> DataFrame:
    """band, place, doc, size, reach for the buckets with two members or more; reach: the sizes of all buckets of the document."""
    all_places = stored(places(reps), "bands")
    sizes = all_places.groupBy("band", "place").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    members = stored(all_places.join(sizes, ["band", "place"]), "buckets")
    reach = members.groupBy("doc").agg(F.sum("size").alias("reach"))
    return members.join(reach, "doc")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The shingle sets of the wanted(doc_id) documents: fp1, fp2, n_shingles, held (sorted hashes)."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [shingles(t, width).tobytes() for t in texts_of(b.column(0))]
            halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, held)), dtype="<i8").reshape(-1, 2)
            n = pa.array([len(h) // 8 for h in held], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), n, pa.array(held, pa.binary())], names=["fp1", "fp2", "n_shingles", "held"])

    wanted = stored(wanted, "wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    rows = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").select("text")
    return rows.mapInArrow(run, "fp1 long, fp2 long, n_shingles long, held binary").where(F.col("n_shingles") > 0)


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) -> a, b, n_a, n_b, both: the sizes of the sets and of their intersection."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                at = np.searchsorted(y, x)
                sizes.append((len(x), len(y), int((y[np.minimum(at, len(y) - 1)] == x).sum())))
            arrays = [pa.array(s, pa.int64()) for s in (zip(*sizes, strict=True) if sizes else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], names=["a", "b", "n_a", "n_b", "both"])

    left, right = sets.select(F.col("doc").alias("a"), F.col("held").alias("x")), sets.select(F.col("doc").alias("b"), F.col("held").alias("y"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return rows.mapInArrow(run, "a long, b long, n_a long, n_b long, both long")


def linked(percent: int) -> Column:
    return 100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> doc, comp (the smallest doc of its component), by turns of pointing to the smallest neighbour. Every turn
    is a table in the shared folder; a hub's neighbours are reduced to a minimum before they are shuffled."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before:
            return edges.select(F.col("u").alias("doc"), F.col("v").alias("comp"))
        before = now


def with_component(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))


def with_first_id(sets: DataFrame) -> DataFrame:
    """sets(doc, comp, first_id, ...) with comp as the smallest id of the component's documents."""
    of_several = sets.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.min("first_id").alias("least")).where("n > 1").drop("n")
    of_several = stored(of_several, "least-ids")
    if of_several.count() <= BROADCAST_IDS:
        of_several = F.broadcast(of_several)
    return sets.join(of_several, "comp", "left").withColumn("comp", F.coalesce("least", "first_id")).drop("least")


def one_id(rows: DataFrame) -> DataFrame:
    """rows(doc_id, doc) -> a, b: links of the sets that share an id."""
    several = stored(rows.groupBy("doc_id").agg(F.min("doc").alias("b"), F.max("doc").alias("last")).where("b <> last").drop("last"), "repeated-ids")
    if several.isEmpty():
        return several.select(F.col("b").alias("a"), "b")
    return rows.join(several, "doc_id").where("doc <> b").select(F.col("doc").alias("a"), "b").distinct()


def own_shingles(sets: DataFrame) -> DataFrame:
    """sets(doc, held) -> doc, own: how many shingles of a document no other of these documents has."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [np.frombuffer(h, "<i8") for h in b.column(1).to_pylist()]
            for at in range(0, len(held), 1024):
                docs = b.column(0).slice(at, 1024).take(pa.array(np.repeat(np.arange(len(held[at:at + 1024])), [len(h) for h in held[at:at + 1024]])))
                yield pa.RecordBatch.from_arrays([docs, pa.array(np.concatenate(held[at:at + 1024]))], names=["doc", "shingle"])

    each = sets.select("doc", "held").mapInArrow(run, "doc long, shingle long")
    single = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc")).where("n = 1")
    return single.groupBy("doc").agg(F.count(F.lit(1)).alias("own"))


def left_pairs(buckets: DataFrame, comps: DataFrame, hubs: DataFrame, overlaps: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of different components that share a bucket and may still be linked. Two documents share at most what both
    share with the hub, and of the rest what each shares with any other document. A pair is judged in its first bucket alone."""
    members = with_component(buckets.select("band", "place", "doc"), comps)
    by_comp = members.groupBy("band", "place", "comp").agg(F.count(F.lit(1)).alias("n"))
    bucket = by_comp.groupBy("band", "place").agg(F.count(F.lit(1)).alias("n_comps"), F.sum("n").alias("size"), F.max_by("comp", F.struct("n", "comp")).alias("main"))
    bucket = bucket.where("n_comps > 1 and size > 2")
    active = stored(members.join(bucket, ["band", "place"]).join(hubs, ["band", "place"]), "active")
    own = own_shingles(sets.join(active.select("doc").distinct(), "doc", "left_semi"))
    near_hub = overlaps.select(F.col("a").alias("doc"), F.col("b").alias("hub"), "both")
    facts = reps.select("doc", F.col("n_shingles").alias("n"), "registers").join(own, "doc", "left")
    rows = active.join(near_hub, ["doc", "hub"], "left").join(facts, "doc")
    rows = rows.withColumn("both", F.when(F.col("doc") == F.col("hub"), F.col("n")).otherwise(F.coalesce("both", "n")))
    rows = rows.withColumn("rest", F.greatest(F.col("n") - F.col("both") - F.coalesce("own", F.lit(0)), F.lit(0)))
    blocks = F.ceil(F.col("size") / BLOCK)
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc"), "blocks"))
    held = F.struct("doc", "comp", "n", "both", "rest", "registers")
    sides = rows.groupBy("band", "place", "blocks", "block").agg(
        F.collect_list(held).alias("rows"), F.collect_list(F.when(F.col("comp") != F.col("main"), held)).alias("outer"))
    outer = sides.where(F.size("outer") > 0).select("band", "place", F.col("outer").alias("left"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    pairs = outer.join(sides.select("band", "place", "block", F.col("rows").alias("right")), ["band", "place", "block"]).select("left", "right", "band")

    def unpack(column: pa.ListArray) -> Iterator[tuple]:
        ends, flat = column.offsets.to_numpy(), column.values
        fields = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(5)]
        registers = np.frombuffer(b"".join(flat.field(5).to_pylist()), "<u2").reshape(-1, REGISTERS)
        for a, b in zip(ends, ends[1:], strict=False):
            yield (*(f[a:b] for f in fields), registers[a:b])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, band in zip(unpack(batch.column(0)), unpack(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                (da, ca, na, oa, sa, ra), (db, cb, nb, ob, sb, rb) = x, y
                most = np.minimum(oa[:, None], ob) + np.minimum(sa[:, None], sb)
                most = np.minimum(most, np.minimum(na[:, None], nb))
                i, j = np.nonzero((ca[:, None] != cb) & (100 * most >= percent * (na[:, None] + nb - most)))
                for s in range(0, len(i), 4096):
                    p, q = i[s:s + 4096], j[s:s + 4096]
                    same = (ra[p] == rb[q]).reshape(-1, BANDS, ROWS).all(-1)
                    near = estimate(ra[p], rb[q], na[p], nb[q]) >= percent / 100 - MARGIN * sure
                    stay = near & (same.argmax(1) == band)
                    p, q = p[stay], q[stay]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(da[p], db[q])), pa.array(np.maximum(da[p], db[q]))], names=["a", "b"])

    sure = float(np.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS))
    return pairs.mapInArrow(run, "a long, b long").distinct()


def group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id (the smallest doc_id reachable over links, itself included), kept
    (it is that one); one row a row of docs."""
    table = stored(sketches(docs, width), "sketches")
    some = table.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    copies = some.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("first_id"), F.min_by("registers", "doc_id").alias("registers"))
    reps, salt = stored(copies, "representatives"), 0
    while not reps.groupBy(number(salt).alias("doc")).count().where("count > 1").isEmpty():
        salt += 1
    reps = reps.withColumn("doc", number(salt))
    buckets = stored(shared_buckets(reps), "shared-buckets")
    hubs = stored(buckets.groupBy("band", "place").agg(F.max_by("doc", F.struct("reach", F.bitwise_not("doc"))).alias("hub")), "hubs")

    starred = buckets.join(hubs, ["band", "place"]).where("doc <> hub").select(F.col("doc").alias("a"), F.col("hub").alias("b"))
    wanted = reps.join(buckets.select("doc").distinct(), "doc", "left_semi").select(F.col("first_id").alias("doc_id")).distinct()
    sets = stored(sets_of(docs, wanted, width).select(number(salt).alias("doc"), "held").dropDuplicates(["doc"]), "sets")
    overlaps = stored(confirm(starred.distinct(), sets), "overlaps")
    links = overlaps.where(linked(percent)).select("a", "b").unionByName(one_id(some.select("doc_id", number(salt).alias("doc"))))
    comps = components(links)
    more = stored(confirm(left_pairs(buckets, comps, hubs, overlaps, reps, sets, percent), sets).where(linked(percent)).select("a", "b"), "more-links")
    if not more.isEmpty():
        comps = components(comps.select(F.col("doc").alias("a"), F.col("comp").alias("b")).unionByName(more))

    of_set = with_first_id(with_component(reps.select("fp1", "fp2", "n_shingles", "doc", "first_id"), comps)).drop("doc", "first_id")
    rows = table.select("doc_id", "n_shingles", "fp1", "fp2").join(of_set, ["fp1", "fp2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("comp")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.col("doc_id") == F.col("component_id"))
