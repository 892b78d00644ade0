"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Bytes of text that a Python task holds in expanded form at a time.
CHUNK_BYTES = 2 << 20
#: Up to so many rows (doc_id and a hash of the text) are broadcast to the documents that they are taken from.
BROADCAST_ROWS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir). Where it is unset, a local session,
    which has no other machine, gets a temporary one; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


class Written(NamedTuple):
    df: DataFrame
    path: str

    def discard(self) -> None:
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write(df: DataFrame) -> Written:
    """Computes df once into the shared folder; what reads it afterwards has no lineage beyond the files,
    so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return Written(spark.read.schema(df.schema).parquet(path), path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on the session passes rows to Python in batches of at most `rows`: a batch of whole texts is held by the
    executor and by its Python worker at once, in several forms."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    spark.conf.set(name, str(min(rows, now) if now > 0 else rows))


def few(rows: DataFrame) -> DataFrame:
    """Written rows, broadcast to what they are joined with if they are at most BROADCAST_ROWS, so that it is not shuffled."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of whole rows with about `limit` bytes of text each (one longer text is a slice of its own),
    and their texts as UTF-8 bytes, null as empty."""
    for batch in batches:
        whole = batch.column(column).cast(pa.binary())
        texts: list[bytes] = []
        first = size = 0
        for i, value in enumerate(whole):
            text = value.as_py() or b""
            if texts and size + len(text) > limit:
                yield batch.slice(first, i - first), texts
                first, size, texts = i, 0, []
            texts.append(text)
            size += len(text)
        if texts:
            yield batch.slice(first), texts


class IdTable:
    """Ids by part of a text, kept in flat arrays; parts repeat, so most are looked up. A table of over `most` parts
    forgets those met least often. Subclasses split texts and learn new parts."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.clear()

    def split(self, text) -> list:
        raise NotImplementedError

    def learn(self, parts: list) -> None:
        raise NotImplementedError

    def clear(self) -> None:
        self.codes: dict = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.length, self.met = (np.zeros(1 << 16, np.int64) for _ in range(3))

    def forget(self) -> None:
        """Drops the parts met least often, half of them at least."""
        n = len(self.codes)
        stays = self.met[:n] > np.partition(self.met[:n], n // 2)[n // 2]
        parts = [p for p, s in zip(self.codes, stays.tolist()) if s]  # codes are in order of insertion
        first, length = self.first[:n][stays], self.length[:n][stays]
        ids = self.flat[spread(first, length)]
        self.clear()
        self.add(parts, ids, length)

    def add(self, parts: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Parts with their ids one after the other."""
        n, code = len(parts), len(self.codes)
        while code + n > len(self.first):
            self.first, self.length, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.length, self.met))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        ends = np.cumsum(lengths)
        self.first[code : code + n], self.length[code : code + n] = self.used + ends - lengths, lengths
        self.used += len(ids)
        self.codes.update(zip(parts, range(code, code + n)))

    def lookup(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and where each text's begin and end among them."""
        if len(self.codes) > self.most:
            self.forget()
        split = [self.split(t) for t in texts]
        parts = [p for ps in split for p in ps]
        if new := list(set(parts).difference(self.codes)):
            self.learn(new)
        codes = np.fromiter(map(self.codes.__getitem__, parts), np.int64, len(parts))
        self.met[: len(self.codes)] += np.bincount(codes, minlength=len(self.codes))
        lengths = self.length[codes]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        return self.flat[spread(self.first[codes], lengths)], ends[np.concatenate(([0], np.cumsum([len(ps) for ps in split]))).astype(np.int64)]


def spread(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each of the given lengths, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(first - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def fold(doc_id: str, modulus: int):
    """The split that the labelled operators learn by: crc32 of the id's decimal text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def of_group(rows: DataFrame, groups: DataFrame, key: str, size: str, hot_groups: int = 1000) -> DataFrame:
    """rows with the columns of their group, but for its size. A group of over 1 / hot_groups of all rows is joined
    by broadcast, of which there can be at most hot_groups; no other fills a task."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    groups = write(groups).df
    least = max(2, total // hot_groups + 1)
    hot = F.broadcast(groups.where(F.col(size) >= least).drop(size))
    rare = groups.where(F.col(size) < least).drop(size)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rare, key))


def numbered(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """rows with their place (long, from 0) in `order` within `by`, and the size of their group. Rows are dealt by range
    and written, so that each range is counted as it was dealt; only counts of ranges meet by group, and a group of
    any size is numbered by ranges. `by` must not be null; equal rows are numbered in any order."""
    dealt = rows.withColumn("seq", F.monotonically_increasing_id()).repartitionByRange(by, *order, "seq").withColumn("part", F.spark_partition_id())
    dealt = write(dealt).df
    counts = dealt.groupBy(by, "part").agg(F.count("*").alias("rows"))
    group = W.partitionBy(by)
    before = F.sum("rows").over(group.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("rows")
    offsets = counts.select(by, "part", before.alias("before"), F.sum("rows").over(group).alias("size"))
    inside = F.row_number().over(W.partitionBy(by, "part").orderBy(*order, "seq"))
    return dealt.join(offsets, [by, "part"]).withColumn("place", F.col("before") + inside - 1).drop("part", "before", "seq")


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) links to (node, component), component being the smallest node reachable.

    Large-star and small-star rounds: each round writes its edges to the shared folder, so lineage stays
    short, and only edge counts and a checksum reach the driver. A path of n nodes takes O(log n) rounds. The links of
    a node with very many are spread (of_group).
    """
    def canonical(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def digest(e: DataFrame):
        return e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()

    now = write(canonical(edges))
    seen = digest(now.df)
    while seen["n"]:
        both = now.df.unionByName(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("degree"))
        large = of_group(both.where("b > a"), least, "a", "degree").select(F.col("b").alias("a"), F.col("m").alias("b"))
        half = write(canonical(large))
        least = half.df.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
        small = of_group(half.df, least, "a", "degree").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        following = write(canonical(small))
        half.discard()
        now.discard()
        now, last, seen = following, seen, digest(following.df)
        if last == seen:
            break
    return now.df.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(now.df.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def between(listed: DataFrame, size: int) -> DataFrame:
    """The rows of lists (key, node, component, ...) dealt into blocks (key, i, j) so that every two members of a list that
    are of different components meet in a block at least. Of lists with the same members one is dealt, if `same` (a
    column that tells what else must agree, where there is one) sums up alike.

    The members of a list's largest component meet all others, not each other. Each side is dealt by hash into parts of
    about `size` members, so a block holds about 2 * size rows at most however long the list.
    """
    told = F.xxhash64(*[c for c in ("node", "same") if c in listed.columns]).cast("decimal(38,0)")
    sized = listed.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum(told).alias("sum"))
    alike = sized.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.sum("sum").alias("sum"))
    alike = alike.where("main.n < all").groupBy("all", "sum").agg(F.min(F.struct("key", "main")).alias("one"))
    parts = lambda n: F.ceil(n / size).cast("int")
    lists = write(alike.select("one.key", F.col("one.main.component").alias("main"), parts(F.col("one.main.n")).alias("mains"), parts(F.col("all") - F.col("one.main.n")).alias("others"))).df
    rows = listed.join(lists, "key").withColumn("inside", F.col("component") == F.col("main")).withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.when(F.col("inside"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    counted = lambda n: F.sequence(F.lit(0), n - 1)
    with_others = F.transform(F.filter(counted(F.col("others")), lambda o: o != F.col("part")), lambda o: pair(F.col("mains") + F.least(o, "part"), F.greatest(o, F.col("part"))))
    blocks = F.when(F.col("inside"), F.transform(counted(F.col("others")), lambda o: pair(F.col("part"), o))).otherwise(F.concat(F.transform(counted(F.col("mains")), lambda m: pair(m, F.col("part"))), with_others))
    return rows.withColumn("block", F.explode(blocks)).select(*listed.columns, "block.i", "block.j")


def connecting(labels: np.ndarray, near) -> list[tuple[int, int]]:
    """Pairs of places that connect all places of different labels which are near each other: near(k, rest) are those of
    the places `rest` that are near place k. A pair that found pairs connect already is not asked for."""
    labels = np.unique(labels, return_inverse=True)[1]
    order = np.argsort(np.bincount(labels)[labels], kind="stable")  # the largest component last
    found, labels = [], labels.copy()
    for at, k in enumerate(order):
        rest = order[at + 1 :]
        rest = rest[labels[rest] != labels[k]]
        if not len(rest):
            continue
        hits = near(k, rest)
        met, first = np.unique(labels[hits], return_index=True)
        found += [(int(k), int(hits[f])) for f in first]
        labels[np.isin(labels, met)] = labels[k]
    return found
