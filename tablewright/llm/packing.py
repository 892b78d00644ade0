"""Best-fit packing of tokenised documents into training sequences."""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import IdTable, text_chunks, write

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"


#: Bytes of texts that split further than at white space: ASCII without the apostrophe, which begins
#: contractions, and the two-byte letters from U+00C0 to U+00FF, without the signs U+00D7 and U+00F7.
PLAIN = bytes(b for b in range(128) if b != 0x27) + bytes([0xC3]) + bytes(range(0x80, 0xC0))
LATIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
RUNS = re.compile(rb"[a-z\xc3\x80-\xbf]+|[^\sa-z\xc3\x80-\xbf]+")


def units(text: bytes) -> list[bytes]:
    """Parts of a text whose ids in order are the text's. The tokenizer lower-cases, drops white space and never
    joins across it, nor across the edge of a run of letters; special tokens' strings keep their case."""
    if b"<|" in text:
        return text.split()
    text = text.lower()
    if text.translate(None, PLAIN) or b"\xc3\x97" in text or b"\xc3\xb7" in text:
        return text.split()
    return RUNS.findall(text)


class WordTable(IdTable):
    """Token ids by unit of text."""

    def __init__(self, tokenizer_path: str, most: int = 600_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        super().__init__(most)

    def split(self, text: bytes) -> list[bytes]:
        return units(text)

    def learn(self, words: list[bytes]) -> None:
        """Runs of letters are one pre-token each, so a thousand of them go into one call; others go singly."""
        runs, others = [], []
        for w in words:
            (runs if w.isalpha() or LATIN.fullmatch(w) else others).append(w)
        for at in range(0, len(runs), 1000):
            part = runs[at : at + 1000]
            encoding = self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False)
            self.add(part, np.array(encoding.ids, np.uint32), np.bincount(encoding.word_ids, minlength=len(part)))
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in others], add_special_tokens=False)]
        self.add(others, np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        ids, ends = self.lookup(texts)
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]


@lru_cache(1)
def word_table(tokenizer_path: str) -> WordTable:
    """A worker's table, kept from task to task."""
    return WordTable(tokenizer_path)


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece of at most `capacity` tokens; only longer documents have several. Token ids stay in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_table(tokenizer_path)
        for batch, texts in text_chunks(batches):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), words.encode(texts)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def best_fit(demand: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> np.ndarray:
    """Vector best fit: the bin of every item, items taken in the given order.

    demand: items x dimensions, each at most capacity. An item goes to the open bin with room in every
    dimension that has the least weighted norm of what would remain ("norm") or the greatest weighted
    dot product of demand and remaining room ("dot"), both in shares of capacity; the oldest wins ties.
    """
    room, names = np.empty((len(demand), demand.shape[1])), np.empty(len(demand), np.int64)
    least = demand.min(axis=0) if len(demand) else capacity
    bins, used, opened = np.empty(len(demand), np.int64), 0, 0
    scale = weights / np.square(capacity)
    for i, d in enumerate(demand):
        left = room[:used] - d
        if rule == "norm":
            score = np.square(left) @ scale
        else:
            score = -((room[:used] * d) @ scale)
        score[(left < 0).any(axis=1)] = np.inf
        k = int(score.argmin()) if used else -1
        if k < 0 or score[k] == np.inf:
            k, names[used] = used, opened
            room[k] = capacity
            used, opened = used + 1, opened + 1
        bins[i] = names[k]
        room[k] -= d
        if (room[k] < least).any():  # no item fits any more
            used -= 1
            room[k:used], names[k:used] = room[k + 1 : used + 1].copy(), names[k + 1 : used + 1].copy()
    return bins


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, max_documents: int | None = None, max_attention: float | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm", shard_pieces: int = 24_000) -> DataFrame:
    """Packs every document into sequences of at most `capacity` tokens, `max_documents` pieces and
    `max_attention` attention cost (the sum of squared piece lengths).

    By default a sequence holds at most 256 pieces, or four times as many as a full sequence of this corpus has on
    average if that is more, and the attention cost of one piece of `capacity` tokens, the least that admits every
    piece. Residual tokens, pieces and cost weigh alike in the choice of a sequence. Pieces are dealt by hash into
    shards of about `shard_pieces`, each packed in one task of bounded size by decreasing length; a shard leaves
    about one sequence partly filled. Null text counts as empty (one piece holding the end id); rows that repeat a
    document are packed again; a null doc_id is carried through; other columns are ignored; an empty table
    gives no rows. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, one row per piece.
    """
    pieces = write(tokenize_pieces(docs, tokenizer_path, capacity, end_id)).df
    total = pieces.agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).first()
    usual = total["n"] * capacity / max(1, total["tokens"] or 0)
    limits = np.array([capacity, max_documents or max(256, math.ceil(4 * usual)), max_attention or float(capacity) ** 2], float)
    if limits[2] < float(capacity) ** 2:
        raise ValueError("max_attention must admit one piece of `capacity` tokens")
    shards = max(1, math.ceil(total["n"] / shard_pieces))
    share = np.array(weights, float)

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        length = rows["length"].to_numpy(float)
        bins = best_fit(np.column_stack([length, np.ones(len(rows)), np.square(length)]), limits, share, rule)
        before = rows["length"].groupby(bins).cumsum() - rows["length"]
        return rows.drop(columns="shard").assign(sequence_id=(int(key[0]) << 32) + bins, offset=before)

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(place, PLACED)
