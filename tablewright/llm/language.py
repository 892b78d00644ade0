"""Language identification by multilingual mixture inference."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import text_chunks

#: Trigram buckets of up to 64 languages; more languages halve them as they double, so a model has at most 2^22 cells.
BUCKETS = 1 << 16
CELLS = 1 << 22
UNDETERMINED = "und"
FOUND = "lang_pred string, score double, languages array<struct<lang:string,proportion:double>>"


class Model(NamedTuple):
    langs: list[str]
    logs: np.ndarray  # buckets x languages, log probabilities

    @property
    def shift(self) -> int:
        """By how many bits trigram buckets are shortened."""
        return (BUCKETS // len(self.logs)).bit_length() - 1


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all words of the texts in order; where each word begins in them; words per text.

    A word is a run of letters, lower-cased, between two blanks; its trigrams are those that hold a letter
    in the middle, so a word has as many as letters.
    """
    lowered = [t.decode("utf-8", "replace").lower() for t in texts]
    points = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "replace"), np.uint32)
    inside = letters()[points]
    points = np.where(inside, points, np.uint32(32)).astype(np.uint64)
    middle = np.flatnonzero(inside)
    mixed = points[middle - 1] * np.uint64(0x9E3779B1) + points[middle] * np.uint64(0x85EBCA77) + points[middle + 1] * np.uint64(0xC2B2AE3D)
    buckets = ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
    first = np.flatnonzero(~inside[middle - 1])
    ends = np.cumsum([len(t) + 1 for t in lowered])  # of each text in points
    count = np.diff(np.searchsorted(middle[first], np.concatenate(([0], ends)), side="left")) if len(middle) else np.zeros(len(texts), int)
    return buckets, first, count


def fit(docs: DataFrame, sample_rows: int = 20_000) -> Model:
    """Trigram probabilities by language from text and lang of docs.

    The classifier is fitted on a sample of about `sample_rows` of the rows, drawn by a hash of the doc_id
    (all of them where there are no more). At most CELLS counts reach the driver.
    """
    docs = docs.where("lang is not null and text is not null")
    share = min(1.0, sample_rows / max(1, docs.count()))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < round(share * 1_000_000)).select(F.col("text").cast("string").alias("text"), "lang")
    n_langs = drawn.select("lang").distinct().count()
    buckets_of = BUCKETS
    while buckets_of > 1 and n_langs * buckets_of > CELLS:
        buckets_of //= 2
    shift = (BUCKETS // buckets_of).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch, texts in text_chunks(batches):
            buckets, first, count = words(texts)
            buckets >>= shift
            lang = np.array(batch.column("lang").to_pylist(), object)
            of_word = np.repeat(lang, count)
            of_gram = np.repeat(of_word, np.diff(np.append(first, len(buckets))))
            for name in set(lang):
                counts[name] = counts.get(name, 0) + np.bincount(buckets[of_gram == name], minlength=buckets_of)
        for name, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])

    total = drawn.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = total.toPandas()
    langs = sorted(rows["lang"].unique())
    table = np.full((buckets_of, max(1, len(langs))), 0.1)
    for k, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        table[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
    return Model(langs, np.log(table / table.sum(axis=0)).astype(np.float32))


def mixture(likelihood: np.ndarray, starts: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation of every text's language proportions, all texts of a chunk at once.

    likelihood: words x languages; allowed: texts x languages. Returns the proportions and the
    log likelihood of each text under them.
    """
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        weight = likelihood * np.repeat(share, sizes, axis=0)
        weight /= weight.sum(axis=1, keepdims=True)
        share = np.add.reduceat(weight, starts, axis=0) / sizes[:, None]
    fit = np.log(np.einsum("ij,ij->i", likelihood, np.repeat(share, sizes, axis=0)))
    return share, np.add.reduceat(fit, starts)


def infer(model: Model, texts: list[bytes], rounds: int = 12, penalty: float = 3.0) -> list[tuple[str, float, list[tuple[str, float]]]]:
    """Language, its proportion, and all selected languages with their proportions, for each text.

    The sets are the best single language and the languages of the largest proportions, two to all of them; the
    one with the greatest log likelihood less `penalty` x log(words + 1) for each language after the first is
    taken. A text is left out of the larger sets only when no mixture at all could reach its best so far: by
    concavity none exceeds a given one's likelihood by more than words x log of the greatest mean ratio of a
    language's likelihood to it.
    """
    grams, first, count = words(texts)
    grams >>= model.shift
    result: list[tuple[str, float, list[tuple[str, float]]]] = [(UNDETERMINED, 0.0, [])] * len(texts)
    some = np.flatnonzero(count)
    if not len(some) or not model.langs:
        return result
    logs = np.add.reduceat(model.logs[grams], first, axis=0).astype(np.float64)
    likelihood = np.maximum(np.exp(logs - logs.max(axis=1, keepdims=True)), 1e-12)
    sizes = count[some]
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    n, k = len(some), len(model.langs)
    single = np.add.reduceat(np.log(likelihood), starts, axis=0)
    best = np.zeros((n, k))
    best[np.arange(n), single.argmax(axis=1)] = 1
    value = single.max(axis=1)
    if k > 1:
        full, reached = mixture(likelihood, starts, sizes, np.ones((n, k)), rounds)
        ratio = likelihood / np.einsum("ij,ij->i", likelihood, np.repeat(full, sizes, axis=0))[:, None]
        bound = reached + sizes * np.log(np.add.reduceat(ratio, starts, axis=0).max(axis=1) / sizes) + 1e-6
        order = np.argsort(-full, axis=1, kind="stable")
        for size in range(2, k + 1):
            cost = penalty * np.log(sizes + 1) * (size - 1)
            left = np.flatnonzero(bound - cost > value)
            if not len(left):
                break
            allowed = np.zeros((len(left), k))
            np.put_along_axis(allowed, order[left, :size], 1.0, axis=1)
            own = np.isin(np.repeat(np.arange(n), sizes), left)
            share, fit = mixture(likelihood[own], np.concatenate(([0], np.cumsum(sizes[left])[:-1])), sizes[left], allowed, rounds)
            fit -= cost[left]
            better = fit > value[left]
            best[left[better]], value[left[better]] = share[better], fit[better]
    for at, row in zip(some, best):
        chosen = np.argsort(-row, kind="stable")
        langs = [(model.langs[j], float(row[j])) for j in chosen if row[j] > 0]
        result[at] = (langs[0][0], min(1.0, langs[0][1]), langs)
    return result


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and languages of each whole text added.

    Null texts and texts without a letter are `und` with score 0, as is everything if the model has learned
    no language. Equal proportions: the language that sorts first. Every row comes out with its own columns;
    those of the three new names give way.
    """
    docs = docs.drop("lang_pred", "score", "languages")
    fields = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("lang_pred", "string"), ("score", "double"), ("languages", "array<struct<lang:string,proportion:double>>"))])
    schema = docs.select("*", fields.alias("_")).select(*[f"`{c}`" for c in docs.columns], "_.*").schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most CELLS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lang", pa.string()), ("proportion", pa.float64())]))
        for batch, texts in text_chunks(batches):
            pred, score, langs = zip(*infer(shared.value, texts))
            langs = [[{"lang": a, "proportion": b} for a, b in x] for x in langs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, kind)], names=[*batch.schema.names, "lang_pred", "score", "languages"])

    return docs.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents for which a set of languages is found: those without a letter go, texts in several stay."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    marked = identify(docs.select(F.col("text").cast("string").alias("text"), own), model)
    return marked.where(F.col("lang_pred") != UNDETERMINED).select("own.*")
