"""Chroma fingerprints of audio columns and their alignment."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import between, components, connecting, of_group, spread, text_chunks, write


class Settings(NamedTuple):
    """Of 8-bit unsigned mono PCM: samples a second, a frame's and a step's samples, the range of pitches."""

    rate: int = 8000
    frame: int = 256
    hop: int = 64
    lowest: float = 60.0
    highest: float = 3600.0


#: Frames under a filter bank, and so the least number of frames for one packed integer.
SPAN = 16
#: (kind, first pitch class, pitch classes, frames): sixteen filters of two bits each.
#: kinds: 0 all; 1 upper half less lower half in pitch; 2 later half less earlier half; 3 checkerboard of quarters; 4 middle third of pitch less the rest; 5 middle third of time less the rest.
FILTERS = ((0, 0, 3, 15), (0, 4, 4, 9), (1, 0, 4, 12), (1, 3, 6, 8), (1, 6, 6, 16), (1, 2, 8, 4), (2, 0, 6, 14), (2, 5, 5, 10), (2, 8, 4, 16), (2, 1, 10, 6), (3, 0, 8, 8), (3, 4, 8, 14), (4, 0, 9, 12), (4, 3, 9, 6), (5, 2, 6, 15), (5, 6, 5, 9))
#: Thresholds of a filter's log ratio between its two sides; of kind 0, between it and a flat spectrum's share.
STEPS = np.array([-0.25, 0.0, 0.25])
GRAY = np.array([0, 1, 3, 2], np.uint32)


def chroma(pcm: np.ndarray, settings: Settings) -> np.ndarray:
    """frames x 12 energies by pitch class, each frame scaled to length 1, smoothed over five frames."""
    count = 1 + (len(pcm) - settings.frame) // settings.hop if len(pcm) >= settings.frame else 0
    if not count:
        return np.zeros((0, 12))
    frequency = np.fft.rfftfreq(settings.frame, 1 / settings.rate)
    heard = (frequency >= settings.lowest) & (frequency <= settings.highest)
    pitch = np.round(12 * np.log2(frequency[heard] / 440)).astype(int) % 12
    to_class = np.zeros((heard.sum(), 12))
    to_class[np.arange(len(pitch)), pitch] = 1
    window = np.hanning(settings.frame)
    out = np.empty((count, 12))
    views = np.lib.stride_tricks.sliding_window_view(pcm, settings.frame)[:: settings.hop]
    for at in range(0, count, 2048):
        spectrum = np.fft.rfft(views[at : at + 2048] * window, axis=1)[:, heard]
        out[at : at + 2048] = (spectrum.real**2 + spectrum.imag**2) @ to_class
    padded = np.pad(out, ((2, 2), (0, 0)), "edge")
    out = sum(w * padded[k : k + count] for k, w in enumerate((0.25, 0.75, 1.0, 0.75, 0.25)))
    norm = np.sqrt(np.square(out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-9)


def fingerprint(pcm: np.ndarray, settings: Settings = Settings()) -> np.ndarray:
    """Packed integers of a recording, one for each place of the 16-frame filter bank."""
    frames = chroma(np.asarray(pcm, np.float64), settings)
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return image[at + t1, y1] - image[at + t0, y1] - image[at + t1, y0] + image[at + t0, y0]

    codes = np.zeros(n, np.uint32)
    for kind, y, height, width in FILTERS:
        half_t, half_y, third_t, third_y, top = width // 2, y + height // 2, width // 3, height // 3, y + height
        whole = area(0, width, y, top)
        if kind == 0:
            one, other = whole / (height * width), np.full(n, 12**-0.5)
        elif kind == 1:
            one, other = area(0, width, half_y, top), area(0, width, y, half_y)
        elif kind == 2:
            one, other = area(half_t, width, y, top), area(0, half_t, y, top)
        elif kind == 3:
            one = area(0, half_t, y, half_y) + area(half_t, width, half_y, top)
            other = whole - one
        elif kind == 4:
            one = area(0, width, y + third_y, top - third_y)
            other = (whole - one) / 2
        else:
            one = area(third_t, width - third_t, y, top)
            other = (whole - one) / 2
        value = np.log((1e-3 + np.maximum(one, 0)) / (1e-3 + np.maximum(other, 0)))
        codes = (codes << np.uint32(2)) | GRAY[np.searchsorted(STEPS, value)]
    return codes


#: Codes in a run that two recordings must have in common to be compared.
RUN = 3
#: Lists of runs up to this length are compared pair by pair in rows, longer ones in blocks of about so many members.
FEW, BLOCK = 4, 1024
#: Meetings of runs, or codes to be compared, that a task lists at a time.
MEETINGS = 1 << 20


def runs(codes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of `length` codes, by place."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    mixed = np.zeros(n, np.uint64)
    for k in range(length):
        mixed = (mixed ^ codes[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    return mixed.view(np.int64)


def fingerprints(recordings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, codes array<int>, digest binary) of recordings (doc_id, audio binary). The codes are the packed
    integers' bits as signed integers."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sounds in text_chunks(batches, "audio"):
            found = [fingerprint(np.frombuffer(s, np.uint8) - 128.0, settings) for s in sounds]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([c.view(np.int32) for c in found], pa.list_(pa.int32())), pa.array([hashlib.sha256(c.tobytes()).digest() for c in found], pa.binary())],
                names=["doc_id", "codes", "digest"],
            )

    return recordings.select("doc_id", "audio").mapInArrow(compute, "doc_id long, codes array<int>, digest binary")


def postings(nodes: DataFrame, length: int = RUN) -> DataFrame:
    """(key, place, node, size): the runs of `length` codes of (node, codes), each once, with the number of codes. The
    place of a run that the recording repeats is -1."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, owners, sizes = [], [], [], []
            for node, codes in zip(batch.column("node").to_pylist(), batch.column("codes")):
                found, place, times = np.unique(runs(codes.values.to_numpy(zero_copy_only=False).view(np.uint32), length), return_index=True, return_counts=True)
                keys.append(found)
                places.append(np.where(times > 1, -1, place))
                owners.append(np.full(len(found), node))
                sizes.append(np.full(len(found), len(codes.values)))
            if keys:
                kinds = (np.int64, np.int32, np.int64, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(k)) for x, k in zip((keys, places, owners, sizes), kinds)], names=["key", "place", "node", "size"])

    return nodes.select("node", "codes").mapInArrow(post, "key long, place int, node long, size int")


def histogram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many equal runs of x and y meet at each offset (the place of x's start in y), from -len(runs of x) on."""
    xs, ys = runs(x, RUN), runs(y, RUN)
    votes = np.zeros(len(xs) + len(ys) + 1, np.int64)
    order = np.argsort(ys, kind="stable")
    first, last = (np.searchsorted(ys[order], xs, side) for side in ("left", "right"))
    keys, place, times = np.unique(xs, return_inverse=True, return_counts=True)
    heavy = (times[place] * (last - first)) > MEETINGS
    for key in np.unique(place[heavy]):  # runs repeated over and over: their meetings are counted by correlation
        size = 1 << (len(xs) + len(ys)).bit_length()
        product = np.fft.rfft(ys == keys[key], size) * np.conj(np.fft.rfft(xs == keys[key], size))
        both = np.rint(np.fft.irfft(product, size)).astype(np.int64)
        votes[len(xs) - np.arange(1, len(xs))] += both[size - np.arange(1, len(xs))]
        votes[len(xs) : len(xs) + len(ys)] += both[: len(ys)]
    light = np.flatnonzero(~heavy & (last > first))
    parts = np.cumsum(last[light] - first[light]) // MEETINGS
    for part in np.unique(parts):
        at = light[parts == part]
        count = last[at] - first[at]
        votes += np.bincount(order[spread(first[at], count)] - np.repeat(at, count) + len(xs), minlength=len(votes))
    return votes


def decided(x: np.ndarray, y: np.ndarray, max_errors: float, least_overlap: float) -> tuple[int, float] | None:
    """The offset at which most runs of x and y meet (the shortest, then the largest, of several), and the share of bits
    that differ there; None if the two are not linked."""
    votes = histogram(x, y)
    if not votes.any():
        return None
    best = np.flatnonzero(votes == votes.max()) - max(len(x) - RUN + 1, 0)
    offset = int(max(best.tolist(), key=lambda o: (-abs(o), o)))
    a, b = x[max(-offset, 0) :], y[max(offset, 0) :]
    both = min(len(a), len(b))
    errors = float(np.bitwise_count(a[:both] ^ b[:both]).sum()) / (32.0 * both)
    return (offset, errors) if both >= least_overlap * min(len(x), len(y)) and errors <= max_errors else None


def align(recordings: DataFrame, settings: Settings = Settings(), max_errors: float = 0.15, least_overlap: float = 0.5) -> DataFrame:
    """One row per recording: doc_id, codes, class_id, aligned_to, offset, bit_errors.

    Recordings with equal codes are one node. Two nodes that have a run of RUN codes in common are compared: the
    histogram of the place differences of such runs gives their offset, and they are linked if at that offset the
    codes overlap for `least_overlap` of the shorter recording and differ in at most `max_errors` of their bits.
    Every run of every recording is posted. First all members of a list are compared with its smallest doc_id; then every
    list that still holds members of several classes is compared pair by pair between these, whatever its length: lists
    of up to FEW in rows, longer ones in blocks (between). Pairs inside a class are connected already. So crowds of
    copies cost no pairs, and no class is missed; unlike recordings that share a run cost all their pairs. A pair is
    only looked into if it overlaps enough at a place where a shared run lies, which holds for every linked pair at its
    offset; the histogram is always that of all their runs.

    class_id is the smallest doc_id reachable over links, aligned_to the linked recording compared with the fewest
    bit errors (then the smallest), offset the place of this recording's start in it. A recording too short for a
    code, or null, is alone in its class; repeated rows come out once each; other columns are ignored; an empty
    table gives no rows.
    """
    prints = write(fingerprints(recordings, settings)).df
    heard = prints.where(F.size("codes") > 0)
    # doc_id decides the node; equal codes have equal runs, so any row's will do
    nodes = write(heard.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("codes").alias("codes"), F.count("*").alias("copies"))).df

    def enough(place, size, other_place, other_size):
        """Whether two recordings overlap enough with the given places one on the other; if one repeats the run, perhaps."""
        both = F.least(place, other_place) + F.least(size - place, other_size - other_place)
        return (place < 0) | (other_place < 0) | (both >= least_overlap * F.least(size, other_size))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([c.values.to_numpy(zero_copy_only=False).view(np.uint32) for c in batch.column(name)] for name in ("x", "y"))
            found = []
            for a, b, p, q in zip(batch.column("less").to_pylist(), batch.column("more").to_pylist(), x, y):
                (node, p), (other, q) = ((a, p), (b, q)) if a > b else ((b, q), (a, p))
                if link := decided(p, q, max_errors, least_overlap):
                    found.append((node, other, *link))
            columns = zip(*found) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.float64()))], names=["node", "other", "offset", "errors"])

    linked = "node long, other long, offset int, errors double"

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among pairs (node, other, size, other_size), node > other. The shorter recording's codes travel to the
        longer's, which are dealt once a recording."""
        first = F.col("size") <= F.col("other_size")
        met = write(pairs.select(F.when(first, F.col("node")).otherwise(F.col("other")).alias("less"), F.when(first, F.col("other")).otherwise(F.col("node")).alias("more")).distinct()).df
        of = lambda name, codes: nodes.select(F.col("node").alias(name), F.col("codes").alias(codes))
        return write(met.join(of("less", "x"), "less").join(of("more", "y"), "more").mapInArrow(judge, linked)).df

    posted = postings(nodes)
    lists = write(posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")).df
    listed = write(posted.join(lists, "key")).df
    centres = listed.groupBy("key").agg(F.min(F.struct("node", "place", "size")).alias("c"))
    centred = write(listed.join(centres, "key")).df
    to_centre = centred.where((F.col("node") != F.col("c.node")) & enough(F.col("place"), F.col("size"), F.col("c.place"), F.col("c.size")))
    links = verified(to_centre.select("node", F.col("c.node").alias("other"), "size", F.col("c.size").alias("other_size")))

    classed = write(components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))).df
    rows = write(centred.where("n > 2").join(classed, "node", "left").withColumn("component", F.coalesce("component", "node"))).df
    few = rows.where((F.col("n") <= FEW) & (F.col("node") != F.col("c.node"))).groupBy("key").agg(F.collect_list(F.struct("node", "place", "size", "component")).alias("m"))
    apart = lambda x, y: (y["node"] < x["node"]) & (y["component"] != x["component"]) & enough(x["place"], x["size"], y["place"], y["size"])
    pairs = few.select(F.explode(F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: apart(x, y)), lambda y: F.struct(x["node"].alias("node"), y["node"].alias("other"), x["size"].alias("size"), y["size"].alias("other_size")))))).alias("p"))
    short = verified(pairs.select("p.*"))

    def compare(block: pa.Table) -> pa.Table:
        owners, labels, places = (block.column(c).to_numpy() for c in ("node", "component", "place"))
        codes = [c.values.to_numpy(zero_copy_only=False).view(np.uint32) for c in block.column("codes")]
        sizes = np.array([len(c) for c in codes], np.int64)
        flat, starts, places = np.concatenate(codes), np.cumsum(sizes) - sizes, places.astype(np.int64)
        links = {}

        def likely(k: int, rest: np.ndarray) -> np.ndarray:
            """Those of `rest` that overlap enough and err little where the list's run lies; all who repeat it."""
            before = np.minimum(places[k], places[rest])
            both = before + np.minimum(sizes[k] - places[k], sizes[rest] - places[rest])
            repeated = (places[rest] < 0) | (places[k] < 0)
            once = np.flatnonzero(~repeated & (both >= least_overlap * np.minimum(sizes[k], sizes[rest])))
            kept = [np.flatnonzero(repeated)]
            parts = np.cumsum(both[once]) // MEETINGS
            for part in np.unique(parts):
                at = once[parts == part]
                x = flat[spread(starts[k] + places[k] - before[at], both[at])]
                y = flat[spread(starts[rest[at]] + places[rest[at]] - before[at], both[at])]
                errors = np.add.reduceat(np.bitwise_count(x ^ y).astype(np.int64), np.cumsum(both[at]) - both[at])
                kept.append(at[errors / (32.0 * both[at]) <= max_errors])
            return rest[np.sort(np.concatenate(kept))]

        def near(k: int, rest: np.ndarray) -> np.ndarray:
            met, hits = set(), []
            for j in likely(k, rest).tolist():
                if labels[j] in met:
                    continue
                a, b = (k, j) if owners[k] > owners[j] else (j, k)
                if link := decided(codes[a], codes[b], max_errors, least_overlap):
                    links[k, j] = (int(owners[a]), int(owners[b]), *link)
                    met.add(labels[j])
                    hits.append(j)
            return np.array(hits, np.int64)

        found = [links[pair] for pair in connecting(labels, near)]
        columns = zip(*found) if found else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.float64()))], names=["node", "other", "offset", "errors"])

    # lists of the same members at the same distances are one
    once = (F.col("place") >= 0) & (F.col("c.place") >= 0)
    same = F.when(once, F.col("place") - F.col("c.place")).when(F.col("place") < 0, F.lit(-(1 << 30))).otherwise(F.col("place") + (1 << 29))
    long = between(rows.where(F.col("n") > FEW).select("key", "node", "component", "place", same.alias("same")), BLOCK).join(nodes.select("node", "codes"), "node")
    dealt = write(long.groupBy("key", "i", "j").applyInArrow(compare, linked)).df
    links = links.unionByName(short).unionByName(dealt)
    links = links.dropDuplicates(["node", "other", "offset"])
    member = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    ways = links.unionByName(links.select(F.col("other").alias("node"), F.col("node").alias("other"), (-F.col("offset")).alias("offset"), "errors"))
    best = ways.groupBy("node").agg(F.min(F.struct("errors", "other", "offset")).alias("best"))
    of_node = nodes.select("digest", "node", "copies").join(member, "node", "left").join(best, "node", "left").select("digest", "copies", F.coalesce("component", "node").alias("class_id"), "best")
    alone = prints.where(F.size("codes") == 0).withColumn("class_id", F.col("doc_id")).withColumn("best", F.lit(None).cast(of_node.schema["best"].dataType))
    out = of_group(heard, of_node, "digest", "copies").unionByName(alone)
    return out.select("doc_id", "codes", F.coalesce("class_id", "doc_id").alias("class_id"), F.col("best.other").alias("aligned_to"), F.col("best.offset").cast("int").alias("offset"), F.col("best.errors").alias("bit_errors"))
