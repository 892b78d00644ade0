"""Merkle manifest of a dataset: leaves by row, trees by group, one root, and a proof for every row."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import numbered, write

#: Characters of a digest as hex text.
DIGEST = 64
PATH = "array<struct<members: string, slot: int>>"


def leaf(*values: Column) -> Column:
    """The hash of a row's values: `-` for null, else the UTF-8 byte count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def sibling(place: Column, offset: Column, fanout: int) -> Column:
    """The place `offset` slots from a slot-zero node in its run; by exclusive or where runs are pairs."""
    return place.bitwiseXOR(offset) if fanout == 2 else place + offset


def runs(nodes: DataFrame, fanout: int) -> DataFrame:
    """The parents of nodes (tree, place, size, hash): tree, place, size (of their level), members (the run's
    hashes from left to right, as one text) and hash.

    Each slot-zero node looks for its siblings by their computed places, in one equijoin; no group is larger than a
    run. A last run may be of one.
    """
    zero = nodes.where(F.col("place") % fanout == 0)
    room = F.least(F.lit(fanout - 1).cast("long"), F.col("size") - F.col("place") - 1)
    offsets = F.when(room > 0, F.sequence(F.lit(1).cast("long"), room))
    wanted = zero.select("tree", "size", F.col("place").alias("first"), F.col("hash").alias("own"), F.explode_outer(offsets).alias("offset"))
    wanted = wanted.withColumn("place", sibling(F.col("first"), F.col("offset"), fanout))
    joined = wanted.join(nodes.select("tree", "place", "hash"), ["tree", "place"], "left")
    found = F.collect_list(F.when(F.col("hash").isNotNull(), F.struct("offset", "hash")))
    gathered = joined.groupBy("tree", "first").agg(F.first("size").alias("size"), F.first("own").alias("own"), F.array_sort(found).alias("siblings"))
    members = F.concat("own", F.array_join(F.transform("siblings", lambda s: s["hash"]), ""))
    up = gathered.select("tree", F.floor(F.col("first") / fanout).alias("place"), F.ceil(F.col("size") / fanout).alias("size"), members.alias("members"))
    return up.withColumn("hash", F.sha2("members", 256))


def grow(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level, from the leaves up, and (tree, hash) of every tree's root. A tree of one node has no
    run. Levels are written one by one; their number is the logarithm of the largest tree."""
    most = nodes.agg(F.max("size")).first()[0] or 0
    levels, roots, level = [], nodes.where("size = 1").select("tree", "hash"), nodes
    while most > 1:
        level = write(runs(level.where("size > 1"), fanout)).df
        levels.append(level)
        roots = roots.unionByName(level.where("size = 1").select("tree", "hash"))
        most = math.ceil(most / fanout)
    return levels, roots


def lift(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The leaves' runs with what lies above them: tree, place, members, above (the runs that hold the run's hash,
    then its parent's and so on, with the slots) and subroot. tops: tree, subroot, above."""
    lifted = None
    for level in reversed(levels):
        here = level.where("size = 1").join(tops, "tree").select("tree", "place", "members", "above", "subroot")
        if lifted is not None:
            parents = lifted.select("tree", F.col("place").alias("parent"), F.col("members").alias("run"), "above", "subroot")
            children = level.where("size > 1").withColumn("parent", F.floor(F.col("place") / fanout)).join(parents, ["tree", "parent"])
            here = here.unionByName(children.select("tree", "place", "members", step(F.col("run"), fanout).alias("above"), "subroot"))
        lifted = write(here).df
    return lifted


def step(members: Column, fanout: int) -> Column:
    """The path of the node at `place` in its run, whose own path is `above`."""
    return F.concat(F.array(F.struct(members.alias("members"), (F.col("place") % fanout).cast("int").alias("slot"))), F.col("above")).cast(PATH)


def located(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """nodes with `path`, from their own run up to the last below the root of all, and their tree's subroot."""
    alone = nodes.where("size = 1").join(tops, "tree").withColumn("path", F.col("above").cast(PATH)).drop("above")
    if not levels:
        return alone
    parents = lift(levels, tops, fanout).withColumnRenamed("place", "parent")
    inside = nodes.where("size > 1").withColumn("parent", F.floor(F.col("place") / fanout)).join(parents, ["tree", "parent"])
    return alone.unionByName(inside.withColumn("path", step(F.col("members"), fanout)).drop("above", "members", "parent"))


def manifest(rows: DataFrame, leaf_hash: Column, key: str = "doc_id", group: str = "source", claims: Sequence[tuple[str, Column]] = (), fanout: int = 16) -> DataFrame:
    """One row for every row: the key, leaf, subroot (of its group), root (of all), path (struct of a run's
    members and the slot, level by level) and the given `claims`, hashes that fold() can carry up.

    Leaves of a group ascend by key (null first, equal keys by hash); groups ascend by their UTF-8 bytes, null
    first. While a level has several nodes, every `fanout` consecutive ones become their hash; what remains is the
    subroot, and the subroots likewise give the root. Repeated rows are leaves of their own. Other columns are
    ignored; an empty table gives no rows.

    Places are numbered by ranges (common.numbered), so a group of any size is spread; every join is by tree and place.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    hashed = write(rows.select(F.col(f"`{key}`").alias("key"), tree.alias("tree"), leaf_hash.alias("hash"), *[c.alias(n) for n, c in claims])).df
    nodes = write(numbered(hashed, "tree", ["key", "hash"])).df
    levels, subroots = grow(nodes, fanout)
    named = write(subroots.withColumnRenamed("tree", "group").withColumn("tree", F.lit(""))).df
    trunk = write(numbered(named, "tree", ["group"])).df
    upper, roots = grow(trunk, fanout)
    root = roots.select("hash").first()
    whole = trunk.select("tree").distinct().withColumn("subroot", F.lit(None).cast("string")).withColumn("above", F.array().cast(PATH))
    tops = located(trunk, upper, whole, fanout).select(F.col("group").alias("tree"), F.col("hash").alias("subroot"), F.col("path").alias("above"))
    found = located(nodes, levels, write(tops).df, fanout)
    return found.select(F.col("key").alias(key), F.col("hash").alias("leaf"), "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), "path", *[n for n, _ in claims])


def left_of(run: Column) -> Column:
    return F.substring(run["members"], F.lit(1), run["slot"] * DIGEST)


def right_of(run: Column) -> Column:
    return F.substring(run["members"], (run["slot"] + 1) * DIGEST + 1, F.length(run["members"]))


def proof_hash(path: Column) -> Column:
    """The hash of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda run: F.concat(left_of(run), right_of(run))), ""), 256)


def fold(claimed: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, claimed, lambda now, run: F.sha2(F.concat(left_of(run), now, right_of(run)), 256))
