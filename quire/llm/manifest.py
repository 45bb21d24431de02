"""Merkle manifest of a table, with a proof for every row by pointer jumping.

Rows are leaves of one tree a group, in the order of their key; eight consecutive nodes become one, the last run of a level may be
shorter. The groups' roots, in the order of the groups, are the leaves of the top tree. A digest is the lower-case hex SHA-256 of its
inputs one after the other, digests as hex text.

Places: leaves are sorted over ranges of (group, key, digest), not by a window per group, so a group with most rows is dealt over many
tasks. A leaf's place is its place in its range and a shift per range and group, a table of as many rows as ranges and groups.
Levels: a run is the eight nodes of one place / 8, so no task meets more than eight rows of a key.
Proofs: every node but the root holds a pointer to its parent and a segment, the digests left and right of it in its run. A round joins
the nodes with themselves, pointer to node: a node takes its pointer's pointer and appends its segment. The distance to the ancestor
doubles, so the rounds are the logarithm of the height. Nodes that reached the root rest. In the round of distance d at most 8^d nodes
point to one ancestor: 4,096 in the third round, and from the fourth on the ancestors are fewer than a hundred-millionth of the leaves.
Leaves stay in their runs until the runs have reached the root, and then take their own segment and their run's.

Every level and round is a table in the shared folder; a lost executor repeats tasks of one step only.

Defined cases: null fields are hashed as `-`; a null group is a group of its own, before the others; null keys come first; rows with
the same key are ordered by their digest, equal rows are leaves of their own; a group of one row has that leaf as its root; an empty
table gives no rows and a null root; texts are hashed whole; other columns are ignored unless they are carried, and carried names may
clash with none of the operator's, since they are nested.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts one after the other, as bytes."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def field_text(value: Column) -> Column:
    """A field as it is hashed: its byte count, a colon and its text, or a dash if it is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return digest(*[field_text(f) for f in fields])


def placed(rows: DataFrame, group: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """rows with place, from 0 within the group by `order`, nulls first, and the groups with n, their rows."""
    spark = rows.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    ranged = stored(ranged.withColumn("range", F.shiftright(at, 33)).withColumn("at", at.bitwiseAND(F.lit((1 << 33) - 1))), name)
    counts = ranged.groupBy("range", *group).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # as many rows as ranges and groups; the ranges of a group follow each other
    before = F.sum("n").over(_window(group).orderBy("range").rowsBetween(_UNBOUNDED, -1))
    counts = stored(counts.select("*", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift")), f"{name}-ranges")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ["range", *group]]
    joined = ranged.alias("r").join(counts.drop("n", "first").alias("c"), same)
    out = joined.select("r.*", (F.col("at") + F.col("shift")).alias("place")).drop("range", "at")
    return out, counts.groupBy(*group).agg(F.sum("n").alias("n"))


def _window(group: list[str]):
    from pyspark.sql import Window
    return Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))


_UNBOUNDED = -(1 << 63)


def parents(nodes: DataFrame, level: int, fanout: int) -> DataFrame:
    """nodes(tree, place, n, node, digest, ...) -> a row a run: tree, place, n, node (its name), digest, run (its nodes in order). A
    node alone in its level stays what it is: the run has its digest."""
    run = F.array_sort(F.collect_list(F.struct("place", "node", "digest", "inner")))
    rows = nodes.groupBy("tree", F.floor(F.col("place") / fanout).alias("up")).agg(F.max("n").alias("m"), run.alias("run"))
    text = F.array_join(F.transform("run", lambda x: hexed(x["digest"])), "")
    return rows.select(
        "tree", F.col("up").alias("place"), F.ceil(F.col("m") / fanout).alias("n"),
        F.concat_ws(":", "tree", F.lit(level), "up").alias("node"), (F.col("m") > 1).alias("hashed"), "run",
        F.when(F.col("m") > 1, digest(text)).otherwise(F.col("run")[0]["digest"]).alias("digest"))


def beside(run: Column, left: bool) -> Column:
    """For each node of a run: the digests left or right of it, as bytes one after the other."""
    nothing = F.lit(b"")
    return F.transform(run, lambda x, i: F.aggregate(
        F.slice(run, F.lit(1) if left else i + 2, i if left else F.size(run) - i - 1), nothing, lambda a, y: F.concat(a, y["digest"])))


def segments(runs: DataFrame, stay: list[str]) -> DataFrame:
    """The nodes of each run with up (their run's name) and steps: one step of left and right digests, none in a run that is no hash."""
    parts = F.arrays_zip("run", beside(F.col("run"), True).alias("left"), beside(F.col("run"), False).alias("right"))
    rows = runs.select("hashed", F.col("node").alias("up"), *stay, F.explode(parts).alias("x"))
    step = F.struct(F.col("x.left").alias("left"), F.col("x.right").alias("right"))
    none = F.slice(F.array(step), 1, 0)
    return rows.select(F.col("x.run").alias("leaf"), "up", *stay, F.when(F.col("hashed"), F.array(step)).otherwise(none).alias("steps"))


def climb(links: DataFrame, root: str, height: int) -> DataFrame:
    """links(node, up, steps, subroot) with every pointer moved to the root, by doubling."""
    rounds = max(height - 1, 0).bit_length()
    done, rest = links.where(F.col("up") == root), links.where(F.col("up") != root)
    for k in range(rounds):
        ahead = links.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("subroot").alias("sub"))
        moved = rest.join(ahead, "up").select("node", F.col("next").alias("up"), F.concat("steps", "more").alias("steps"),
                                              F.coalesce("subroot", "sub").alias("subroot"))
        links = stored(done.unionByName(moved), f"merkle-jump-{k}")
        done, rest = links.where(F.col("up") == root), links.where(F.col("up") != root)
    return done


@dataclass(frozen=True)
class Manifest:
    """root: the hex digest of the whole table (null if it is empty); rows: a row a leaf with group, digest (bytes), carried (a struct),
    subroot (hex) and steps, its proof: the digests left and right of it from its run up to the root."""

    root: str | None
    rows: DataFrame

    def folded(self, start: Column) -> Column:
        """The root that follows from a leaf digest (bytes) and the row's proof, as hex."""
        return F.aggregate("steps", hexed(start), lambda a, s: F.sha2(F.concat(hexed(s["left"]), a, hexed(s["right"])).cast("binary"), 256))

    def proof_digest(self) -> Column:
        """One digest of the proof: its sibling digests from the leaf up, left to right."""
        return F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(hexed(s["left"]), hexed(s["right"]))), "").cast("binary"), 256)


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id", carry: list[Column] | None = None,
          fanout: int = FANOUT) -> Manifest:
    """The manifest of docs. carry: columns that go with each leaf."""
    held = docs.select(F.col(group).alias("grp"), F.col(key).alias("key"), leaf([F.col(f) for f in fields]).alias("digest"),
                       F.struct(*(carry or [F.lit(0).alias("none")])).alias("carried"))
    held = stored(held, "merkle-leaves")
    leaves, groups = placed(held, ["grp"], ["key", "digest"], "merkle-places")
    trees, _ = placed(groups, [], ["grp"], "merkle-groups")
    trees = stored(trees.withColumnRenamed("place", "tree"), "merkle-trees")
    count, most = trees.agg(F.count("*"), F.max("n")).first()
    if not count:
        return Manifest(None, held.select("grp", "digest", "carried", F.lit("").alias("subroot"),
                                          F.expr("cast(array() as array<struct<left:binary,right:binary>>)").alias("steps")))
    nodes = leaves.alias("l").join(trees.alias("t"), F.col("l.grp").eqNullSafe(F.col("t.grp"))).select(
        "t.tree", "l.place", "t.n", F.lit(None).cast("string").alias("node"), "l.digest", F.struct("l.grp", "l.carried").alias("inner"))
    runs = bottom = stored(parents(nodes, 1, fanout), "merkle-runs")
    plain = F.lit(None).cast(nodes.schema["inner"].dataType).alias("inner")
    links, tops, height = [], [], 1

    def linked(level: DataFrame) -> DataFrame:
        return segments(level, []).select("leaf.node", "up", "steps", F.lit(None).cast("binary").alias("subroot"))

    while True:
        tops.append(runs.where("n = 1"))
        most = -(-most // fanout)
        if most <= 1:
            break
        level = runs.where("n > 1").select("tree", "place", "n", "node", "digest", plain)
        height += 1
        runs = stored(parents(level, height, fanout), f"merkle-level-{height}")
        links.append(linked(runs))
    if count == 1:
        root_node, root = _only(tops)
    else:
        level = _union([t.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(count).alias("n"), "node", "digest", plain)
                        for t in tops])
        runs, first = stored(parents(level, 1, fanout), "merkle-top-1"), True
        up = 1
        while True:
            made = segments(runs, [])
            own = F.col("leaf.digest") if first else F.lit(None).cast("binary")
            links.append(made.select("leaf.node", "up", "steps", own.alias("subroot")))
            count, first = -(-count // fanout), False
            if count <= 1:
                break
            up += 1
            runs = stored(parents(runs.select("tree", "place", "n", "node", "digest", plain), up, fanout), f"merkle-top-{up}")
        height += up
        root_node, root = _only([runs])
    far = None
    if links:
        far = climb(stored(_union(links), "merkle-links"), root_node, height)
    return Manifest(bytes(root).hex(), _proofs(bottom, far, root))


def _only(tables: list[DataFrame]) -> tuple[str, bytes]:
    """Name and digest of the one node of these tables."""
    return tuple(_union([t.select("node", "digest") for t in tables]).first())


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _proofs(bottom: DataFrame, far: DataFrame | None, root: bytes) -> DataFrame:
    """The leaves of the lowest runs with their own step and those of their run."""
    if far is None:
        rows = segments(bottom, []).withColumn("subroot", F.lit(None).cast("binary"))
    else:
        # the run whose node is the root itself has no row in far
        with_run = bottom.select("hashed", "node", "run").join(far.select("node", F.col("steps").alias("more"), "subroot"), "node", "left")
        rows = segments(with_run, ["more", "subroot"])
        rows = rows.withColumn("steps", F.when(F.col("more").isNull(), F.col("steps")).otherwise(F.concat("steps", "more")))
    return rows.select("leaf.inner.grp", "leaf.digest", "leaf.inner.carried", hexed(F.coalesce("subroot", F.lit(root))).alias("subroot"), "steps")
