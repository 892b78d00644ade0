"""Ranked lexical search from the items' side: documents stream through an inverted index of the items."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablewright.llm.common import spread, text_chunks, write

#: Bytes that are no part of a term: ASCII without digits and letters.
BLANK = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
#: Bytes of a text that are split at a time.
WINDOW = 1 << 20
#: Cells of the scores (documents x items) and postings that a task holds at a time.
CELLS = 1 << 20


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term: maximal runs of ASCII digits and letters and of all other characters, A-Z lower-cased."""
    if len(text) <= WINDOW:
        return Counter(text.lower().translate(BLANK).split())
    counts: Counter = Counter()
    first = 0
    text = text.lower().translate(BLANK)
    while first < len(text):
        last = text.find(b" ", first + WINDOW)
        last = len(text) if last < 0 else last
        counts.update(text[first:last].split())
        first = last
    return counts


class Index(NamedTuple):
    """Postings of items by term: term k's are items[first[k] : first[k] + length[k]] and their times in the item."""

    terms: dict[bytes, int]
    item_ids: list
    first: np.ndarray
    length: np.ndarray
    items: np.ndarray
    times: np.ndarray


def inverted(items: list[tuple]) -> Index:
    """Index of (item_id, text) rows; rows of one id make one item."""
    counts: dict = {}
    for item_id, text in items:
        counts.setdefault(item_id, Counter()).update(term_counts((text or "").encode()))
    terms: dict[bytes, int] = {}
    posted = np.array([(terms.setdefault(t, len(terms)), k, n) for k, c in enumerate(counts.values()) for t, n in c.items()], np.int64).reshape(-1, 3)
    posted = posted[np.argsort(posted[:, 0], kind="stable")]
    length = np.bincount(posted[:, 0], minlength=len(terms))
    return Index(terms, list(counts), np.cumsum(length) - length, length, posted[:, 1], posted[:, 2])


class Statistics(NamedTuple):
    documents: int
    occurrences: int
    weights: np.ndarray


def counted(docs: DataFrame, index: Broadcast) -> DataFrame:
    """(doc_id, n, terms, tfs): each document's number of terms, and the index's terms in it with their occurrences.
    Documents without a term are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value.terms
        for batch, texts in text_chunks(batches):
            n, size, terms, tfs = [], [], [], []
            for text in texts:
                counts = term_counts(text)
                n.append(counts.total())
                met = [(known[t], c) for t, c in counts.items() if t in known]
                size.append(len(met))
                terms += [t for t, _ in met]
                tfs += [c for _, c in met]
            ends = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>").where("n > 0")


def statistics(counts: DataFrame, index: Index) -> Statistics:
    """N and L over all documents, and the weights of the index's terms; as many rows as it has terms reach the driver."""
    total = counts.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(index.terms), np.int64)
    for row in counts.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        df[row["term"]] = row["count"]
    weights = [math.floor(1000 * math.log((2 * total[0] + 2) / (2 * d + 1))) for d in df.tolist()]
    return Statistics(total[0], total[1] or 0, np.array(weights, np.int64))


def scores(index: Index, stats: Statistics, n: list[int], ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
    """documents x items, for documents with n terms whose entries end at `ends` of terms and tfs."""
    m = np.array([75 + 25 * x * stats.documents // stats.occurrences for x in n], np.int64)
    doc = np.repeat(np.arange(len(n)), np.diff(ends, prepend=0))
    value = stats.weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m[doc]))
    length = index.length[terms]
    at = spread(index.first[terms], length)
    found = np.zeros(len(n) * len(index.item_ids), np.int64)
    np.add.at(found, np.repeat(doc * len(index.item_ids), length) + index.items[at], np.repeat(value, length) * index.times[at])
    return found.reshape(len(n), len(index.item_ids))


class Heaps:
    """The k best documents of every item, as (score, has an id, -id)."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.heaps, self.least = k, [[] for _ in range(items)], np.ones(items, np.int64)

    def update(self, doc_ids: list, found: np.ndarray) -> None:
        """found: documents x items. Only what reaches an item's least kept score is looked at, and of many the best."""
        reached = found >= self.least
        for item in np.flatnonzero(reached.any(axis=0)).tolist():
            docs, heap = np.flatnonzero(reached[:, item]), self.heaps[item]
            score = found[docs, item]
            if len(docs) > self.k:
                best = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
                docs, score = docs[best], score[best]
            for d, s in zip(docs.tolist(), score.tolist()):
                entry = (s, doc_ids[d] is not None, -(doc_ids[d] or 0))
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[item] = heap[0][0]


def streamed(counts: DataFrame, index: Broadcast, stats: Statistics, k: int) -> DataFrame:
    """(item_id, doc_id, score, part): every task's k best documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        heaps = Heaps(len(found.item_ids), k)
        for batch in batches:
            doc_ids, n = batch.column("doc_id").to_pylist(), batch.column("n").to_pylist()
            terms, tfs = batch.column("terms").flatten().to_numpy(), batch.column("tfs").flatten().to_numpy()
            ends = np.cumsum(batch.column("terms").value_lengths().to_numpy())
            work = np.cumsum(np.bincount(np.repeat(np.arange(len(n)), np.diff(ends, prepend=0)), found.length[terms], minlength=len(n)) + len(found.item_ids))
            first = 0
            while first < len(n):
                last = max(first + 1, int(np.searchsorted(work, (work[first - 1] if first else 0) + CELLS)))
                begin, end = int(ends[first - 1]) if first else 0, int(ends[last - 1])
                heaps.update(doc_ids[first:last], scores(found, stats, n[first:last], ends[first:last] - begin, terms[begin:end], tfs[begin:end]))
                first = last
        part = TaskContext.get().partitionId()
        rows = [(found.item_ids[i], -d if known else None, s, part) for i, heap in enumerate(heaps.heaps) for s, known, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)], names=["item_id", "doc_id", "score", "part"])

    return counts.mapInArrow(run, "item_id long, doc_id long, score long, part long")


def rank(docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = 500_000) -> DataFrame:
    """The k documents with the highest score above 0 for every item: item_id, rank (from 1), doc_id, score.

    A document's score for an item sums, over the item's terms with repeats, the term's weight by document
    frequency times its saturated frequency in the document, in whole numbers, over statistics of all documents.
    Equal scores rank by doc_id, null last; rows that repeat a document are documents of their own; null or empty
    texts have no term, reach no item and count in no statistic. Rows of items with the same item_id make one item,
    equal rows count once; other columns are ignored; without documents or items there are no rows.

    Items are taken in blocks of about block_terms words (and one item at least), so that an index has a bound
    whatever the number of items; each block goes over all documents. Their term counts are written once, statistics
    come from them, and then every task streams its part through the broadcast index and keeps k documents an item.
    The tasks' heaps are merged in two steps.
    """
    spark = docs.sparkSession
    asked = write(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()).df
    words = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(words / 4 / block_terms))
    merged = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        built = inverted([tuple(r) for r in rows])
        index = spark.sparkContext.broadcast(built)
        counts = write(counted(docs, index)).df
        best = streamed(counts, index, statistics(counts, built), k)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        near = best.withColumn("bucket", F.col("part") % 64).withColumn("rank", F.row_number().over(W.partitionBy("item_id", "bucket").orderBy(*order))).where(F.col("rank") <= k)
        ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        merged = ranked if merged is None else merged.unionByName(ranked)
    return merged
