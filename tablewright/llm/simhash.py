"""SimHash near-duplicate detection over a byte-position inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablewright.llm.common import between, components, connecting, few, of_group, text_chunks, write

LANES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the 64-bit hashes. Each byte lane of a word counts up to 255 hashes at a time."""
    n = len(hashes)
    if not n:
        return 0
    padded = np.zeros(-(-n // 255) * 255, np.uint64)
    padded[:n] = hashes
    padded = padded.reshape(-1, 255)
    result = 0
    for bit in range(8):
        lanes = ((padded >> np.uint64(bit)) & LANES).sum(axis=1, dtype=np.uint64)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in range(8):
            if 2 * counts[byte] > n:
                result |= 1 << (8 * byte + bit)
    return result


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: len(words) - shingle])).tolist()
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    return majority(np.array(hashes, np.uint64))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long): the 64-bit SimHash of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            found = np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight byte positions agree."""
    differing = a.bitwiseXOR(b)
    return sum((F.shiftrightunsigned(differing, 8 * i).bitwiseAND(F.lit(255)) == 0).cast("int") for i in range(8))


def links(distinct: DataFrame, max_bits: int = 2, index_bytes: int = 5, list_pairs: int = 64) -> DataFrame:
    """(a, b): all pairs of distinct `fp` within `max_bits` bits.

    Two fingerprints that differ in at most k bits agree in at least 8 - k bytes, the count a pair must reach.
    The inverted index is keyed by positions and values of bytes. A list for one byte would hold 1/256 of the
    corpus, so lists are keyed by `index_bytes` bytes together: of any index_bytes + k positions, a pair
    reaching the count shares at least index_bytes, so keying by all subsets of the first index_bytes + k
    positions misses none. Inside a list the shared bytes of each pair are tallied, pairs below the count
    fall out, and the rest are verified bit by bit.

    The members of a list of over `list_pairs` are indexed again by longer keys: all subsets of 16 - k half bytes,
    which a pair within k bits shares just as surely. A list then holds the values of k half bytes, 16^k at most,
    so that no list's pairs grow with the square of its members.
    """
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits: 0 to 7")
    index_bytes = min(index_bytes, 8 - max_bits)
    prefix = index_bytes + max_bits
    halves = [sum(0xF << (4 * i) for i in s) for s in combinations(range(16), 16 - max_bits)]

    def listed(members: DataFrame, masks: list[int]) -> DataFrame:
        """(key, fp, members) of lists with two members or more."""
        keyed = members.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("subset", "values"))
        return keyed.withColumn("members", F.count("*").over(W.partitionBy("subset", "values"))).where("members > 1")

    def pairs(lists: DataFrame) -> DataFrame:
        reached = lambda x, y: (y > x) & (shared_bytes(x, y) >= 8 - max_bits) & (F.bit_count(x.bitwiseXOR(y)) <= max_bits)
        partners = F.transform("fps", lambda x: F.struct(x.alias("a"), F.filter("fps", lambda y: reached(x, y)).alias("bs")))
        return lists.groupBy("subset", "values").agg(F.collect_list("fp").alias("fps")).select(F.explode(partners).alias("p")).select("p.a", F.explode("p.bs").alias("b"))

    index = write(listed(distinct, [sum(0xFF << (8 * i) for i in s) for s in combinations(range(prefix), index_bytes)])).df
    crowded = write(index.where(F.col("members") > list_pairs).select("fp").distinct()).df
    found = pairs(index.where(F.col("members") <= list_pairs))
    if not crowded.isEmpty():
        found = found.unionByName(pairs(listed(crowded, halves)))
    return found.distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, max_bits: int = 2) -> DataFrame:
    """Fingerprint and near-duplicate component of every document: doc_id, fingerprint (16 lowercase hex
    digits), component_id (the smallest doc_id reachable over links of at most max_bits differing bits).

    Texts are lower-cased in A-Z only and split at ASCII white space. A text with fewer words than `shingle`
    is one shingle; one without words, or null, has fingerprint zero and is linked like any other. Equal
    fingerprints are one node from the start, so thousands of copies cost no links. Repeated rows come out
    once each; a null doc_id is kept and is the smallest id only if no other of its component has one; other
    columns are ignored; an empty table gives no rows.
    """
    prints = write(fingerprints(docs, shingle, seed)).df
    distinct = write(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))).df
    member = write(components(links(distinct, max_bits))).df.select(F.col("node").alias("fp"), "component")
    rooted = distinct.join(member, "fp")
    roots = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = rooted.join(roots, "component").select("fp", "component_id")
    named = distinct.join(linked, "fp", "left").select("fp", "copies", F.coalesce("component_id", "least").alias("component_id"))
    return of_group(prints, named, "fp", "copies").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents with one of each near-duplicate component kept: the one with the smallest doc_id.
    A document without an id stays."""
    later = near_duplicates(docs, **options).where("doc_id <> component_id").select("doc_id", "fingerprint").distinct()
    rows = keyed(docs)
    prints = fingerprints(rows.select(F.col("text_key").alias("doc_id"), "text"), options.get("shingle", 3), options.get("seed", 42)).distinct()
    named = prints.select(F.col("doc_id").alias("text_key"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"))
    return without(docs, rows.select("doc_id", "text_key").distinct().join(named, "text_key").join(later, ["doc_id", "fingerprint"], "left_semi"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows of the given doc_id and text_key, so that of rows with one id and several texts only those go
    that are meant."""
    gone = write(gone.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), "text_key").distinct()).df
    key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(few(gone), (docs["doc_id"].cast("long") == gone["_id"]) & (key == gone["text_key"]), "left_anti")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_key), the key being a hash of the text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"))


# --- near duplicates by similarity --------------------------------------------
#
# A similarity of 0.8 is a fifth of the bits apart, far beyond what any choice of whole bytes could guarantee to
# meet. So fingerprints are of 256 bits, the inverted index samples their bytes, and its recall is measured.

#: Words of 64 bits in a long fingerprint.
LONG = 4
#: Byte positions of a long fingerprint under one key, and how many keys a fingerprint has.
KEY_BYTES, KEYS = 5, 128
#: Keys under which crowds are first gathered around a centre.
CENTRE_KEYS = 16
#: Lists up to this length are tallied pair by pair in rows, longer ones in blocks of about so many members.
FEW, BLOCK = 4, 1024
#: Parts of all fingerprints that meet two by two: as many, but of FEW_NODES fingerprints at least and PART_NODES at most;
#: and how many tasks their blocks are dealt to.
PARTS, FEW_NODES, PART_NODES, BLOCK_TASKS = 16, 512, 1 << 17, 2048
#: Fingerprints whose keys are made at a time, and about how many of them a task posts: each makes KEYS rows, which it
#: tallies before they are dealt by key.
POST_ROWS, TASK_ROWS = 512, 4096


def long_fingerprint(hashes: np.ndarray) -> bytes:
    """256 bits, each set in over half of the distinct hashes, of which it takes one bit after mixing."""
    hashes = np.unique(hashes)
    counts = np.zeros(64 * LONG, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        mixed = np.empty((len(part), LONG), np.uint64)
        for k in range(LONG):
            x = (part ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            mixed[:, k] = x ^ (x >> np.uint64(32))
        counts += np.unpackbits(mixed.view(np.uint8).reshape(len(part), 8 * LONG), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` word hashes; of all words together where there are fewer."""
    size = min(size, len(words))
    mixed = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        mixed = (mixed ^ words[k : len(mixed) + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def long_fingerprints(docs: DataFrame, shingle: int, index_shingle: int, seed: int) -> DataFrame:
    """(doc_id, text_key long, fp binary, b0 to b3 long): fp is the fingerprint of index_shingle words, which the index is
    made of, and then that of `shingle` words, whose bits decide and are in b0 to b3 too; text_key is a hash of the text,
    which tells rows of one id apart. A text without words has no fp."""
    bits = [f"b{k}" for k in range(LONG)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            prints: list[bytes | None] = []
            for text in texts:
                words = np.array([xxhash.xxh64_intdigest(w, seed) for w in text.lower().split()], np.uint64)
                prints.append(long_fingerprint(shingle_hashes(words, index_shingle)) + long_fingerprint(shingle_hashes(words, shingle)) if len(words) else None)
            decisive = np.frombuffer(b"".join(p[8 * LONG :] if p else bytes(8 * LONG) for p in prints), np.int64).reshape(-1, LONG)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(prints, pa.binary()), *[pa.array(decisive[:, k]) for k in range(LONG)]], names=["doc_id", "text_key", "fp", *bits])

    return keyed(docs).select("doc_id", "text_key", "text").mapInArrow(run, "doc_id long, text_key long, fp binary, " + ", ".join(f"{b} long" for b in bits))


def similar_links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): links between distinct (node, fp, b0 to b3) whose decisive fingerprints differ in at most max_bits bits,
    enough of them to connect each pair within max_bits: those that the index finds, and what remainder() adds.

    Every fingerprint is posted under KEYS keys of KEY_BYTES bytes at fixed positions. Crowds are gathered first: in the
    long lists of CENTRE_KEYS keys all meet the member that has most company there, which in a crowd of copies is the one
    most like the rest. Then every list of the whole index that still holds members of several components is compared
    pair by pair between its components, whatever its length: lists of up to FEW in rows, longer ones in blocks (between).
    Pairs inside a component are connected already, so that a crowd of copies costs no pairs; a crowd of unlike texts
    costs all of them.
    """
    rng = np.random.default_rng(7)
    places = np.array([np.sort(rng.choice(8 * LONG, KEY_BYTES, replace=False)) for _ in range(KEYS)])

    def posted(rows: DataFrame, keys: int) -> DataFrame:
        """(key, node, component) under the first `keys` keys."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, len(whole), POST_ROWS):
                    batch = whole.slice(at, POST_ROWS)
                    prints = np.frombuffer(b"".join(p[: 8 * LONG] for p in batch.column("fp").to_pylist()), np.uint8).reshape(-1, 8 * LONG)
                    found = np.arange(keys, dtype=np.int64)[None, :] << (8 * KEY_BYTES)
                    for k in range(KEY_BYTES):
                        found = found | (prints[:, places[:keys, k]].astype(np.int64) << (8 * k))
                    owners = [pa.array(np.repeat(batch.column(c).to_numpy(), keys)) for c in ("node", "component")]
                    yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), *owners], names=["key", "node", "component"])

        return rows.select("node", "component", "fp").mapInArrow(run, "key long, node long, component long")

    mine = lambda name: distinct.select(F.col("node").alias(name), *[F.col(f"b{k}").alias(f"{name}{k}") for k in range(LONG)])

    def verified(pairs: DataFrame) -> DataFrame:
        met = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        apart = sum(F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(LONG))
        return write(met.join(mine("a"), "a").join(mine("b"), "b").where(apart <= max_bits).select("a", "b")).df

    def centred() -> DataFrame:
        """Links of the long lists' members to their centres."""
        first = posted(distinct.withColumn("component", F.col("node")), CENTRE_KEYS).drop("component")
        lists = write(first.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > FEW)).df
        many = write(first.join(lists, "key")).df
        company = many.groupBy("node").agg(F.sum("n").alias("company"))
        centres = many.join(company, "node").groupBy("key").agg(F.max(F.struct("company", -F.col("node")))["col2"].alias("negative")).select("key", (-F.col("negative")).alias("centre"))
        return verified(many.join(centres, "key").select(F.col("node").alias("a"), F.col("centre").alias("b")))

    links = centred()
    member = write(components(links)).df
    named = distinct.select("node", "fp").join(member, "node", "left").select("node", "fp", F.coalesce("component", "node").alias("component"))
    rows = write(named.repartition(distinct.count() // TASK_ROWS + 1, "node")).df
    index = posted(rows, KEYS)
    lists = index.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most"))
    lists = write(lists.where("least < most").select("key", "n")).df
    listed = write(index.join(lists, "key")).df
    members = listed.where(F.col("n") <= FEW).groupBy("key").agg(F.collect_list(F.struct("node", "component")).alias("m"))
    others = lambda x: F.filter("m", lambda y: (y["node"] < x["node"]) & (y["component"] != x["component"]))
    pairs = members.select(F.explode(F.flatten(F.transform("m", lambda x: F.transform(others(x), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))).alias("p"))
    short = verified(pairs.select("p.*"))

    bits = [f"b{k}" for k in range(LONG)]

    def compare(block: pa.Table) -> pa.Table:
        nodes, labels = (block.column(c).to_numpy() for c in ("node", "component"))
        prints = np.stack([block.column(b).to_numpy() for b in bits], axis=1).view(np.uint64)
        near = lambda k, rest: rest[np.bitwise_count(prints[rest] ^ prints[k]).sum(axis=1) <= max_bits]
        found = np.array(connecting(labels, near), np.int64).reshape(-1, 2)
        return pa.table({"a": nodes[found].max(axis=1), "b": nodes[found].min(axis=1)})

    long = between(listed.where(F.col("n") > FEW), BLOCK).join(distinct.select("node", *bits), "node")
    dealt = write(long.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")).df
    met = write(links.unionByName(short).unionByName(dealt).distinct()).df
    return met.unionByName(remainder(distinct, met, max_bits))


def remainder(distinct: DataFrame, met: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): links that connect every pair of distinct (node, b0 to b3) within max_bits bits which the links `met` leave apart.

    No choice of keys meets all pairs at such a distance, so all are compared: nodes are dealt by hash into parts, and two
    parts meet in one block. There are at most PARTS parts, more only where they would hold over PART_NODES nodes, so that
    a block is bounded however many nodes there are; the work is the square of their number. Half of the bits rule
    out nearly all pairs.
    """
    n = distinct.count()
    parts = max(1, min(PARTS, n // FEW_NODES), -(-n // PART_NODES))
    bits = [f"b{k}" for k in range(LONG)]
    member = write(components(met)).df
    rows = distinct.select("node", *bits).join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    part = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(parts)).cast("int")
    blocks = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    blocks = blocks.select("*", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).drop("other")

    def compare(block: pa.Table) -> pa.Table:
        nodes, labels, part, i, j = (block.column(c).to_numpy() for c in ("node", "component", "part", "i", "j"))
        words = [block.column(b).to_numpy().view(np.uint64) for b in bits]
        labels, first, second = labels.copy(), np.flatnonzero(part == i), np.flatnonzero(part == j)
        right = [w[second] for w in words]
        apart = lambda k, at, which: sum(np.bitwise_count(right[w][at] ^ words[w][k]).astype(np.int16) for w in which)
        found = []
        for place, k in enumerate(first):
            begin = place + 1 if i[0] == j[0] else 0
            close = begin + np.flatnonzero(apart(k, slice(begin, None), range(LONG // 2)) <= max_bits)
            close = second[close[apart(k, close, range(LONG)) <= max_bits]]
            close = close[labels[close] != labels[k]]
            if len(close):
                told, at = np.unique(labels[close], return_index=True)
                found += [(int(nodes[k]), int(nodes[x])) for x in close[at]]
                labels[np.isin(labels, told)] = labels[k]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs.max(axis=1), "b": pairs.min(axis=1)})

    return write(blocks.repartition(max(1, min(parts * (parts + 1) // 2, BLOCK_TASKS)), "i", "j").groupBy("i", "j").applyInArrow(compare, "a long, b long")).df


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, index_shingle: int = 1, seed: int = 42) -> DataFrame:
    """doc_id, text_key, component_id, head_key: near-duplicate classes of documents whose sets of `shingle` words have a cosine similarity of
    about `similarity`, as the bits of 256-bit SimHashes tell it: they differ in a share of acos(similarity) / pi.

    Equal fingerprints are one node; the candidates come from an inverted index over bytes of the fingerprint of
    `index_shingle` words, whose bits change less: two texts at the limit of 0.8 for five words share 96 % of their single
    words if changes are scattered, and so meet under some key nine times in ten, nearer ones almost always; the pairs that
    the index leaves apart are compared in blocks. component_id is the smallest doc_id reachable,
    head_key the hash of its text (the least, of several rows with that id), text_key of the row's own. Texts are lower-cased in A-Z and split at ASCII white space; a text with fewer words is one shingle; those without words
    are alone. A null doc_id is kept, and is never another's component. Other columns are ignored; an empty table gives no
    rows.
    """
    prints = write(long_fingerprints(docs, shingle, index_shingle, seed)).df
    known = prints.where("fp IS NOT NULL")
    first = [F.first(f"b{k}").alias(f"b{k}") for k in range(LONG)]
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key")))
    groups = write(known.groupBy("fp").agg(least.alias("least"), F.count("*").alias("copies"), *first).withColumn("node", F.monotonically_increasing_id())).df
    max_bits = int(64 * LONG * np.arccos(similarity) / np.pi)
    member = write(components(similar_links(groups, max_bits))).df
    rooted = groups.select("fp", "node", "copies", "least").join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = rooted.groupBy("component").agg(F.min("least").alias("head"))
    named = rooted.join(heads, "component").select("fp", "copies", "head")
    classed = of_group(known.select("doc_id", "text_key", "fp"), named, "fp", "copies")
    alone = prints.where("fp IS NULL").select("doc_id", "text_key", "fp", F.struct("doc_id", "text_key").alias("head"))
    return classed.unionByName(alone).select("doc_id", "text_key", F.coalesce("head.doc_id", "doc_id").alias("component_id"), F.coalesce("head.text_key", "text_key").alias("head_key"))


def drop_similar(docs: DataFrame, **options) -> DataFrame:
    """The documents with one of each class of similar_documents kept: the one with the smallest doc_id. A document
    without an id stays."""
    found = similar_documents(docs, **options)
    later = (F.col("doc_id") != F.col("component_id")) | (F.col("text_key") != F.col("head_key"))
    return without(docs, found.where(later))
