"""Toxicity scores by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import text_chunks, write

BUCKETS = 1 << 20
WORD = re.compile(r"\w+")


class Model(NamedTuple):
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    bias: float
    prior: float


def traits(word: str) -> list[int]:
    """Buckets of a word and of its beginnings of three to six letters."""
    return [zlib.crc32(x.encode("utf-8", "replace")) & (BUCKETS - 1) for x in {f"={word}", *(word[:n] for n in range(3, 7) if len(word) >= n)}]


class Words:
    """Features of texts. A trait makes up to three: that it occurs, that it occurs twice or more, and that it
    does so at least once in `dense` words, numbered trait, BUCKETS + trait and 2 x BUCKETS + trait.
    The traits of words met lately are kept."""

    def __init__(self, only: np.ndarray | None = None, dense: int = 150, most: int = 200_000) -> None:
        self.index = None if only is None else {int(b): i for i, b in enumerate(only)}
        self.bases = None if only is None else {int(b) % BUCKETS for b in only}
        self.cache: dict[str, list[int]] = {}
        self.dense, self.most = dense, most

    def of(self, text: bytes) -> list[int]:
        """The distinct features of a text; places in `only` if that is given."""
        if len(self.cache) > self.most:
            self.cache.clear()
        words = WORD.findall(text.decode("utf-8", "replace").lower())
        times: dict[int, int] = {}
        for word, n in Counter(words).items():
            known = self.cache.get(word)
            if known is None:
                known = traits(word)
                if self.bases is not None:
                    known = [b for b in known if b in self.bases]
                self.cache[word] = known
            for b in known:
                times[b] = times.get(b, 0) + n
        found = list(times)
        found += [BUCKETS + b for b, n in times.items() if n > 1]
        found += [2 * BUCKETS + b for b, n in times.items() if n > 1 and n * self.dense >= len(words)]
        return found if self.index is None else [self.index[b] for b in found if b in self.index]


class Rows(NamedTuple):
    """Texts by their features: the positive ones first, then the unlabelled."""

    row: np.ndarray
    col: np.ndarray
    positive: int
    unlabelled: int

    @classmethod
    def of(cls, positive: list[list[int]], unlabelled: list[list[int]]) -> Rows:
        rows = positive + unlabelled
        return cls(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([c for r in rows for c in r], np.int64), len(positive), len(unlabelled))

    def margins(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.positive + self.unlabelled) + w[-1]


def nn_pu_risk(w: np.ndarray, rows: Rows, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two parts of the positive-unlabelled risk of weights w, the bias last, with the logistic loss l,

        prior x E_P[l(f)]   and   E_U[l(-f)] - prior x E_P[l(-f)],

    and their gradients. The second estimates the risk on texts that are not toxic and so can't be negative."""
    f = rows.margins(w)
    high = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
    loss_neg, p = np.logaddexp(0, f), slice(rows.positive)
    first = prior * np.logaddexp(0, -f[p]).mean()
    rest = loss_neg[rows.positive :].mean() - prior * loss_neg[p].mean()

    def gradient(d: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(rows.col, d[rows.row], len(w) - 1), d.sum())

    is_p = np.arange(len(f)) < rows.positive
    d_first = np.where(is_p, prior * (high - 1) / rows.positive, 0.0)
    d_rest = np.where(is_p, -prior * high / rows.positive, high / rows.unlabelled)
    return float(first), float(rest), gradient(d_first), gradient(d_rest)


def nn_pu_fit(positive: list[list[int]], unlabelled: list[list[int]], width: int, prior: float, rounds: int = 400, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier that minimise the non-negative positive-unlabelled risk

        prior x E_P[l(f)] + max(0, E_U[l(-f)] - prior x E_P[l(-f)])

    by Adam steps over all rows. Where the bracket is negative, the step ascends it, which undoes the
    overfitting that made it so. The bias is then moved so that the mean probability of the unlabelled rows is
    the class prior.
    """
    start = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return np.zeros(width), start
    rows = Rows.of(positive, unlabelled)
    w = np.append(np.zeros(width), start)
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        _, rest, first_g, rest_g = nn_pu_risk(w, rows, prior)
        g = first_g + rest_g if rest >= 0 else -rest_g
        g[:width] += decay * w[:width]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
    return w[:width], float(w[width]) + at_prior(rows.margins(w)[len(positive) :], prior)


def at_prior(margins: np.ndarray, prior: float) -> float:
    """What, added to the margins, makes their mean probability the class prior."""
    low, high = -60.0, 60.0
    for _ in range(80):
        middle = (low + high) / 2
        if (1 / (1 + np.exp(-np.clip(margins + middle, -60, 60)))).mean() < prior:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def fit(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 8000, features: int = 4096, least_documents: int = 5, least_evidence: float = 30.0) -> Model:
    """A toxicity model from confirmed toxic documents and documents without regard to label.

    The classifier is fitted on a bounded sample, drawn by a hash of the doc_id: about `positives` rows labelled
    toxic and about `unlabelled` rows of docs, whatever their labels. Class prior: the share of toxic rows
    among all labelled ones; rows labelled not toxic serve for nothing else. Copies of a text count once. A choice
    of the model: its features are those at least three times as frequent among the positive rows, with a
    likelihood ratio statistic of `least_evidence` or more against equal frequency, and of these the `features`
    strongest. Only these bounded sets reach the driver.
    """
    labels = labels.where("doc_id is not null and toxic is not null").select("doc_id", "toxic")
    counts = labels.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("p")).first()
    n_pos = counts["p"] or 0
    prior = min(0.99, max(0.001, n_pos / max(1, counts["n"])))
    million = 1_000_000
    drawn = lambda seed, most, of: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(million)) < round(million * min(1.0, most / max(1, of)))
    known = labels.where((F.col("toxic") == 1) & drawn(1, positives, n_pos)).select("doc_id").distinct()
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = texts.where(drawn(2, unlabelled, docs.select("doc_id").count()))
    sample = texts.join(F.broadcast(known), "doc_id").select("text", F.lit(True).alias("toxic")).unionByName(chosen.select("text", F.lit(False).alias("toxic")))
    sample = write(sample.dropDuplicates(["text", "toxic"])).df

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, words, rows = np.zeros((2, 3 * BUCKETS), np.int32), Words(), [0, 0]
        for batch, chunk in text_chunks(batches):
            for text, toxic in zip(chunk, batch.column("toxic").to_pylist()):
                seen[int(toxic), words.of(text)] += 1
                rows[int(toxic)] += 1
        at = np.flatnonzero(seen.any(axis=0))
        columns = np.append(at, -1), np.append(seen[1, at], rows[1]), np.append(seen[0, at], rows[0])
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=["bucket", "p", "u"])

    found = sample.mapInArrow(tally, "bucket long, p long, u long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    found = write(found.where(F.col("p") >= F.when(F.col("bucket") < 0, 0).otherwise(least_documents))).df
    size = found.where("bucket = -1").first()
    n_p, n_u = (max(1, size["p"]), max(1, size["u"])) if size else (1, 1)
    expected = F.greatest(F.col("u"), F.lit(1)) * (n_p / n_u)
    evidence = 2 * (F.col("p") * F.log(F.col("p") / expected) - F.col("p") + expected)
    strong = found.where((F.col("bucket") >= 0) & (F.col("p") >= 3 * expected) & (evidence >= least_evidence)).orderBy(evidence.desc(), "bucket").limit(features)
    buckets = np.sort(np.array([r["bucket"] for r in strong.select("bucket").collect()], np.int64))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(buckets)
        for batch, chunk in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([words.of(t) for t in chunk], pa.list_(pa.int64()))], names=["toxic", "features"])

    rows = sample.mapInArrow(reduce, "toxic boolean, features array<long>").collect()
    weights, bias = nn_pu_fit(*([r["features"] for r in rows if r["toxic"] == kind] for kind in (True, False)), len(buckets), prior)
    return Model(buckets, weights, bias, prior)


def score_texts(model: Model, texts: list[bytes], words: Words | None = None) -> np.ndarray:
    words = words or Words(model.buckets)
    value = np.array([model.bias + sum(model.weights[i] for i in words.of(t)) for t in texts])
    return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `toxicity`, a double from 0 to 1, added for each whole text.

    Null and empty texts get the score of a text without features. Every row comes out with its own columns;
    one named toxicity gives way to the new one.
    """
    docs = docs.drop("toxicity")
    schema = docs.select(*[f"`{c}`" for c in docs.columns], F.lit(None).cast("double").alias("toxicity")).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most `features` weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value.buckets)
        for batch, texts in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_texts(shared.value, texts, words))], names=[*batch.schema.names, "toxicity"])

    return docs.mapInArrow(run, schema)


def keep_civil(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents that score below the threshold."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    return score(docs.select(F.col("text").cast("string").alias("text"), own), model).where(F.col("toxicity") < threshold).select("own.*")
