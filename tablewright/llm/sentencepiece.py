"""SentencePiece encoding and decoding by batched Viterbi search."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import IdTable, spread, text_chunks

SPACE = "▁"
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
BASE = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 22


class Pieces:
    """The pieces of a model by hash. A unigram segmentation is the one of greatest total score; a character
    that no piece covers costs more than any piece and is encoded by the byte pieces of its UTF-8."""

    def __init__(self, pieces: Sequence[str], scores: Sequence[float], ids: Sequence[int], byte_ids: Sequence[int]) -> None:
        self.longest = max(map(len, pieces))
        hashes = np.zeros(len(pieces), np.uint64)
        of_length: dict[int, list[int]] = defaultdict(list)
        for i, p in enumerate(pieces):
            of_length[len(p)].append(i)
        for length, at in of_length.items():
            hashes[at] = self.hashes(self.points([pieces[i] for i in at], length))[0][:, length]
        order = np.argsort(hashes)
        self.keys, self.ids, self.scores = hashes[order], np.array(ids, np.int64)[order], np.array(scores, np.float64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.present = np.zeros(1 << FILTER_BITS, bool)
        self.present[self.keys >> np.uint64(64 - FILTER_BITS)] = True
        self.unknown = float(min(scores)) - 10.0
        self.byte_ids = list(byte_ids)

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(model.get_piece_size())
        bytes_ = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = [i for i in n if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        found = cls([model.id_to_piece(i) for i in plain], [model.get_score(i) for i in plain], plain, bytes_)
        spelt = [b""] * model.get_piece_size()
        for i in plain:
            spelt[i] = model.id_to_piece(i).encode()
        for b, i in enumerate(bytes_):
            spelt[i] = bytes([b])
        found.spelling, found.size = np.frombuffer(b"".join(spelt), np.uint8), np.array([len(x) for x in spelt], np.int64)
        found.begin = np.cumsum(found.size) - found.size
        return found

    @staticmethod
    def points(words: Sequence[str], length: int) -> np.ndarray:
        """The code points of words of one length, a row each."""
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length).astype(np.uint64)

    @staticmethod
    def hashes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix hashes of equal-length rows of code points, and the powers that cut substrings out."""
        mixed = (points + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        prefix = np.zeros((len(points), points.shape[1] + 1), np.uint64)
        for j in range(points.shape[1]):
            prefix[:, j + 1] = prefix[:, j] * BASE + mixed[:, j]
        power = np.ones(points.shape[1] + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.multiply.accumulate(np.full(points.shape[1], BASE), out=power[1:])
        return prefix, power

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes among the sorted keys, -1 for those that are no piece."""
        found = np.full(hashes.shape, -1, np.int64)
        maybe = np.nonzero(self.present[hashes >> np.uint64(64 - FILTER_BITS)])
        wanted = hashes[maybe]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        found[maybe] = np.where(self.keys[at] == wanted, at, -1)
        return found

    def segment(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of words of one length one after the other, and how many each has. All words advance together.
        Equal totals: the earliest start wins."""
        n, length = len(words), len(words[0])
        prefix, power = self.hashes(self.points(words, length))
        best = np.zeros((n, length + 1))
        start, piece = np.zeros((n, length + 1), np.int32), np.full((n, length + 1), -1, np.int32)
        rows = np.arange(n)
        for end in range(1, length + 1):
            begins = np.arange(max(0, end - self.longest), end)
            found = self.probe(prefix[:, end, None] - prefix[:, begins] * power[end - begins])
            total = best[:, begins] + np.where(found >= 0, self.scores[found], -np.inf)
            total[:, -1] = np.where(found[:, -1] >= 0, total[:, -1], best[:, end - 1] + self.unknown)
            pick = total.argmax(axis=1)
            best[:, end], start[:, end], piece[:, end] = total[rows, pick], begins[pick], found[rows, pick]
        # all words go back together along their backpointers; ids fill their row from its end
        back, used = np.zeros((n, 4 * length), np.uint32), np.zeros(n, np.int64)
        ends, left = np.full(n, length), rows
        while len(left):
            at = piece[left, ends[left]]
            known = at >= 0
            back[left[known], used[left[known]]] = self.ids[at[known]]
            used[left[known]] += 1
            for w in left[~known].tolist():
                for b in reversed(words[w][ends[w] - 1].encode("utf-8", "replace")):
                    back[w, used[w]] = self.byte_ids[b]
                    used[w] += 1
            ends[left] = start[left, ends[left]]
            left = left[ends[left] > 0]
        return back[:, ::-1][np.arange(4 * length) >= 4 * length - used[:, None]], used

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts that consecutive runs of ids, from ends[k] to ends[k + 1], spell."""
        sizes = self.size[ids]
        spelled = self.spelling[spread(self.begin[ids], sizes)].tobytes()
        cuts = np.concatenate(([0], np.cumsum(sizes)))[ends].tolist()
        found = [spelled[a:b].decode("utf-8", "replace").replace(SPACE, " ") for a, b in zip(cuts[:-1], cuts[1:])]
        return [t[1:] if t.startswith(" ") else t for t in found]


class Encoder(IdTable):
    """Encodes texts word by word: no piece goes on past a blank once other characters have begun, so the
    best segmentation of a text is that of its words."""

    def __init__(self, pieces: Pieces, most: int = 300_000, cells: int = 1 << 19) -> None:
        self.pieces, self.cells = pieces, cells
        super().__init__(most)

    def split(self, text: str) -> list[str]:
        return WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, words: list[str]) -> None:
        of_length: dict[int, list[str]] = defaultdict(list)
        for word in words:
            of_length[len(word)].append(word)
        for length, some in of_length.items():
            step = max(1, self.cells // length)
            for at in range(0, len(some), step):
                self.add(some[at : at + step], *self.pieces.segment(some[at : at + step]))

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        ids, ends = self.lookup(texts)
        return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


@lru_cache(1)
def encoder_of(model_path: str) -> Encoder:
    """A worker's encoder, its model and words kept from task to task."""
    return Encoder(Pieces.load(model_path))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every whole text: its piece ids and what they decode to.

    Null and empty texts have no ids and decode to the empty text. U+2581, the model's own mark for a blank,
    decodes to a blank. Rows come out as they come in; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model_path)
        for batch, texts in text_chunks(batches, limit=1 << 20):
            ids, ends = encoder.lookup([t.decode("utf-8", "replace") for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(encoder.pieces.decode(ids, ends), pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
