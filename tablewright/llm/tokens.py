"""Token counts of whole texts."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import text_chunks

#: White space as the tokenizers' pattern has it, in UTF-8.
SPACE = rb"[\t-\r ]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
WIDE = re.compile(SPACE.removeprefix(rb"[\t-\r ]|"))
#: A run of white space with what follows it up to the next one, for texts whose white space is ASCII, and for all.
PLAIN_UNITS = re.compile(rb"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
WIDE_UNITS = re.compile(rb"(?:%b)*(?:(?!%b)[\x00-\xff])+|(?:%b)+" % (SPACE, WIDE.pattern + rb"|[\t-\r ]", SPACE))
#: A unit that can stand between others: ASCII white space, then none up to its end.
PLAIN_JOIN = re.compile(rb"[\t-\r ]+(?:(?!%b)[\x00-\xff])+" % (WIDE.pattern + rb"|[\t-\r ]"))


def units(text: bytes) -> list[bytes]:
    """The text cut before every white space that follows another character. A byte-level pre-tokenizer keeps white
    space and letters apart but for one space before a word, so no token reaches over such a place and what is on
    one side does not change the tokens on the other."""
    return (WIDE_UNITS if WIDE.search(text) else PLAIN_UNITS).findall(text)


class Lengths:
    """Numbers of tokens by unit of text. Units of up to `keep` bytes are remembered, `most` of them between batches."""

    def __init__(self, tokenizer_path: str, most: int = 1_000_000, keep: int = 64, batch_bytes: int = 1 << 16) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.most, self.keep, self.batch_bytes, self.known = most, keep, batch_bytes, {}
        if tokenizer_path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path)
            self.encode, self.whole = lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)], True
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.encode = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        split = tokenizer.pre_tokenizer.__getstate__() if tokenizer.pre_tokenizer else b""
        byte_level = b'"ByteLevel"' in split and b'"use_regex":true' in split and b'"add_prefix_space":false' in split
        added = tokenizer.get_added_tokens_decoder().values()
        widths = [0] * tokenizer.get_vocab_size()
        for token, i in tokenizer.get_vocab().items():
            widths[i] = len(token)  # a byte-level token has a character for each byte
        self.widths, self.ids = np.array(widths), lambda text: tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        self.whole = not (byte_level and tokenizer.normalizer is None) or any(t.lstrip or t.rstrip or t.single_word or len(units(t.content.encode())) > 1 for t in added)

    def encoded(self, parts: list[bytes]) -> list[int]:
        """Token counts by calls of about batch_bytes; a longer part is a call of its own."""
        found, first, size = [], 0, 0
        for i, part in enumerate([*parts, b""]):
            if i == len(parts) or i > first and size + len(part) > self.batch_bytes:
                found += self.encode([p.decode("utf-8", "replace") for p in parts[first:i]]) if i > first else []
                first, size = i, 0
            size += len(part)
        return found

    def measured(self, parts: list[bytes]) -> list[int]:
        """Token counts of units. Those that begin with white space and end without are encoded one after the other in
        texts of about batch_bytes, and told apart by the bytes that their tokens cover."""
        found = dict.fromkeys(parts, 0)
        joined = [p for p in parts if len(p) <= self.keep and PLAIN_JOIN.fullmatch(p)]
        alone = list(found.keys() - set(joined))
        step = max(1, self.batch_bytes // 16)
        for at in range(0, len(joined), step):
            block = joined[at : at + step]
            try:
                ids = self.ids(b"".join(block).decode())
            except UnicodeDecodeError:
                alone += block
                continue
            ends = np.cumsum(self.widths[ids])
            last = np.searchsorted(ends, np.cumsum([len(p) for p in block])) + 1
            found.update(zip(block, np.diff(last, prepend=0).tolist()))
        found.update(zip(alone, self.encoded(alone)))
        return [found[p] for p in parts]

    def count(self, texts: list[bytes]) -> list[int]:
        if self.whole:
            return self.encoded(texts)
        split = [units(t) for t in texts]
        met = set().union(*split)
        known = self.known
        if len(known) > self.most:
            known = self.known = {u: known[u] for u in met.intersection(known)}
        new = list(met.difference(known))
        known.update(zip(new, self.measured(new)))
        found = [sum(map(known.__getitem__, us)) for us in split]
        for u in new:
            if len(u) > self.keep:
                del known[u]
        return found


@lru_cache(1)
def lengths(tokenizer_path: str) -> Lengths:
    """A worker's counts, kept from task to task."""
    return Lengths(tokenizer_path)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) of every whole text, as the library
    of the tokenizer file counts them: `tokenizers` for .json, `sentencepiece` for .model, with nothing added, cut
    or padded, and strings of special tokens inside a text read as the library does by default.

    Texts are taken in slices of about 2 MB and cut where no token can reach over; the units that a worker has not
    met are encoded in batches of about 64 KB and only their numbers of tokens are kept. Byte-level files are cut so;
    any other is encoded by whole texts in the same batches. A long text without white space is one unit. Null text
    counts as empty (0 tokens); a null doc_id and repeated rows come out as they are; other columns are ignored; an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = lengths(tokenizer_path)
        for batch, texts in text_chunks(batches):
            n = np.array(counter.count(texts), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
