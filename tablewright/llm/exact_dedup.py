"""Exact deduplication against a persistent digest index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import few, write


class DigestIndex:
    """A table of digests seen so far, bucketed and sorted by digest, in the session's warehouse.

    digest binary: SHA-256 of the text in UTF-8; keep_id long: the document that stays. New documents are
    aggregated by digest, held against the index by a sort-merge anti-join that reads the index bucket by
    bucket without a shuffle, and what is new is appended, one file a bucket. The number of buckets is fixed when
    the index is made, one for each `bucket_rows` texts that the first call brings (4 at least): give `buckets`
    where later calls will bring many more.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None, bucket_rows: int = 5_000_000) -> None:
        self.spark, self.buckets, self.bucket_rows = spark, buckets, bucket_rows
        self.name = name or f"digest_index_{uuid.uuid4().hex}"

    def seen(self) -> DataFrame:
        if self.spark.catalog.tableExists(self.name):
            return self.spark.table(self.name)
        return self.spark.createDataFrame([], "digest binary, keep_id long")

    def bucket_count(self, rows: int) -> int:
        if self.spark.catalog.tableExists(self.name):
            described = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").where("col_name = 'Num Buckets'").first()
            return int(described["data_type"])
        return self.buckets or max(4, -(-rows // self.bucket_rows))

    def append(self, digests: DataFrame, rows: int) -> None:
        n = self.bucket_count(rows)
        digests.repartition(n, "digest").write.mode("append").bucketBy(n, "digest").sortBy("digest").saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def deduplicate(self, docs: DataFrame, hot_groups: int = 1000) -> DataFrame:
        """One row per input row: doc_id, keep_id, group_size (rows of this call with the text), kept,
        text_sha256; digests that were not in the index are added to it.

        Texts are equal when identical; null counts as empty. Of equal texts in one call the row with the
        largest doc_id stays, unless the index already names a document: then that one stays and the new rows
        go. Rows with the same doc_id and text are one document, kept together. A null doc_id is never the
        kept id while another has one; alone it is kept. Other columns are ignored; an empty table gives no
        rows and leaves the index as it is.

        Rows join their group on the digest. A group of over 1 / hot_groups of all rows is joined by
        broadcast, of which there can be at most hot_groups; no other fills a task.
        """
        hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).alias("digest"))
        rows = write(hashed).df
        groups = write(rows.groupBy("digest").agg(F.max("doc_id").alias("latest"), F.count("*").alias("group_size"))).df
        sizes = groups.agg(F.count("*").alias("n"), F.sum("group_size").alias("rows")).first()
        fresh = groups.hint("merge").join(self.seen(), "digest", "left_anti")
        self.append(fresh.select("digest", F.col("latest").alias("keep_id")), sizes["n"])
        known = groups.hint("merge").join(self.seen(), "digest").select("digest", "keep_id", "group_size")

        least = max(2, (sizes["rows"] or 0) // hot_groups + 1)
        hot = groups.where(F.col("group_size") >= least).select("digest")
        hot = F.broadcast(known.where(F.col("group_size") >= least).join(F.broadcast(hot), "digest", "left_semi"))
        rare = known.where(F.col("group_size") < least)
        joined = rows.join(hot, "digest").unionByName(rows.join(hot.select("digest"), "digest", "left_anti").hint("merge").join(rare, "digest").select("digest", "doc_id", "keep_id", "group_size"))
        return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def find_exact_duplicates(docs: DataFrame) -> DataFrame:
    """deduplicate() against an index of this call's own, which is dropped again."""
    index = DigestIndex(docs.sparkSession)
    found = write(index.deduplicate(docs)).df
    index.drop()
    return found


def drop_exact_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents that the index keeps, with their columns; a document without an id stays. Without an index
    documents are held against each other only. A row goes by its id and its text together, so that of rows with one id
    and several texts only those go whose text another row holds."""
    found = index.deduplicate(docs) if index else find_exact_duplicates(docs)
    gone = write(found.where("not kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("digest")).distinct()).df
    digest = F.unhex(F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256))
    return docs.join(few(gone), (docs["doc_id"].cast("long") == gone["_id"]) & (digest == gone["digest"]), "left_anti")
