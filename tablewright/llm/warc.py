"""Merkle fixity audit of replicated WARC files."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablewright.llm.common import Written, write


def record_bytes(page_id: Column, url: Column, body: Column) -> Column:
    """A WARC response record; null url and body count as empty."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def page_records(pages: DataFrame, records_per_file: int = 1000, loose_files: int = 4096) -> DataFrame:
    """(file string, position long, record string): pages as WARC records, records_per_file to a file by id.
    Pages without an id are dealt by their content over the places of `loose_files` files of their own."""
    known = F.col("page_id").cast("long")
    content = F.xxhash64("url", "html")
    number = F.floor(known / records_per_file)
    loose = F.concat(F.lit("pages-loose-"), F.pmod(content, F.lit(loose_files)).cast("string"))
    file = F.concat(F.when(known.isNull(), loose).otherwise(F.concat(F.lit("pages-"), number.cast("string"))), F.lit(".warc"))
    position = F.when(known.isNull(), F.pmod(F.shiftright(content, 20), F.lit(records_per_file))).otherwise(known - number * records_per_file)
    return pages.select(file.alias("file"), position.alias("position"), record_bytes(known, F.col("url"), F.col("html")).alias("record"))


def leaves(records: DataFrame) -> DataFrame:
    """One leaf per record place: file, level 0, node (the position), first and last byte offset, content (the hash
    of its bytes) and hash (of its offsets and content).

    Rows that share a place are one leaf whose content covers all of them in any order: their number, least and
    greatest hash and the exclusive-or of their hashes' words.
    """
    dealt = records.select("file", "position", F.sha2(F.coalesce(F.col("record").cast("string"), F.lit("")), 256).alias("content"), F.coalesce(F.octet_length("record"), F.lit(0)).cast("long").alias("bytes"))
    hashed = dealt.repartition("file")  # at most records_per_file places: grouping, offsets and levels follow without another exchange
    words = [F.expr(f"bit_xor(cast(conv(substring(content, {16 * k + 1}, 15), 16, 10) as bigint))").alias(f"w{k}") for k in range(4)]
    merged = hashed.groupBy("file", "position").agg(F.count("*").alias("n"), F.min("content").alias("least"), F.max("content").alias("most"), F.sum("bytes").alias("bytes"), *words)
    several = F.sha2(F.concat_ws("|", "n", "least", "most", "w0", "w1", "w2", "w3"), 256)
    end = F.sum("bytes").over(W.partitionBy("file").orderBy("position"))
    placed = merged.select("file", F.col("position").alias("node"), (end - F.col("bytes")).alias("first"), end.alias("last"), F.when(F.col("n") == 1, F.col("least")).otherwise(several).alias("content"))
    return placed.select("file", F.lit(0).alias("level"), "node", "first", "last", "content", F.sha2(F.concat_ws("|", "first", "last", "content"), 256).alias("hash"))


def tree(records: DataFrame, fanout: int, depth: int) -> Written:
    """All levels of every file's tree, from leaves (0) to root (depth), written to the shared folder. A node hashes
    its range of offsets and, in order, the numbers, ranges and hashes of its at most `fanout` children."""
    level = leaves(records)
    levels = level
    for n in range(1, depth + 1):
        up = level.groupBy("file", F.floor(F.col("node") / fanout).alias("parent")).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sort_array(F.collect_list(F.struct("node", "first", "last", "hash"))).alias("children"))
        joined = F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["node"].cast("string"), c["first"].cast("string"), c["last"].cast("string"), c["hash"])), "|")
        level = up.select("file", F.lit(n).alias("level"), F.col("parent").alias("node"), "first", "last", F.lit(None).cast("string").alias("content"), F.sha2(F.concat_ws("|", "first", "last", joined), 256).alias("hash"))
        levels = levels.unionByName(level)
    return write(levels)


def audit(primary: DataFrame, replica: DataFrame, records_per_file: int = 1000, fanout: int = 16) -> DataFrame:
    """Where a replica differs: file, position, first and last byte offset in the primary (in the replica for
    records that only it has), status corrupt, missing, extra or moved (the same bytes at other offsets, as all
    that follows a lost record has), and both contents' hashes.

    Both inputs are (file, position, record), positions below records_per_file. Roots are compared by file;
    below, only children of differing nodes are read into the comparison, level by level, so equal files cost
    one row each. Null records count as empty; equal rows in other order are equal; other columns are
    ignored; an empty side makes everything missing or extra.
    """
    depth = max(1, math.ceil(math.log(max(2, records_per_file), fanout)))
    ours, theirs = tree(primary, fanout, depth), tree(replica, fanout, depth)
    suspects = None
    for level in range(depth, -1, -1):
        side = lambda t, n: t.df.where(F.col("level") == level).select("file", "node", *[F.col(c).alias(f"{n}_{c}") for c in ("first", "last", "content", "hash")])  # noqa: E731, B023
        a, b = side(ours, "a"), side(theirs, "b")
        if suspects is not None:
            parents = suspects.df.select("file", F.col("node").alias("parent"))
            below = lambda d: d.join(parents, (d["file"] == parents["file"]) & (F.floor(d["node"] / fanout) == parents["parent"]), "left_semi")  # noqa: E731, B023
            a, b = below(a), below(b)
        above, suspects = suspects, write(a.join(b, ["file", "node"], "full").where(~F.col("a_hash").eqNullSafe(F.col("b_hash"))))
        if above is not None:
            above.discard()
    ours.discard()
    theirs.discard()
    status = F.when(F.col("b_hash").isNull(), "missing").when(F.col("a_hash").isNull(), "extra").when(F.col("a_content") == F.col("b_content"), "moved").otherwise("corrupt")
    return suspects.df.select("file", F.col("node").alias("position"), F.coalesce("a_first", "b_first").alias("first"), F.coalesce("a_last", "b_last").alias("last"), status.alias("status"), F.col("a_content").alias("primary_hash"), F.col("b_content").alias("replica_hash"))
