import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablewright.llm import exact_dedup, simhash
from tablewright.llm.common import components

SCHEMA = "doc_id long, text string"


def rows(df):
    return [tuple(r) for r in df.collect()]


def brute_fingerprint(text, size=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(prints, bits):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints_and_components_equal_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    docs = {}
    for i in range(120):
        if i and rng.random() < 0.5:
            text = docs[rng.randrange(i)].split(" ")
            text[rng.randrange(len(text))] = rng.choice(words)
            docs[i] = " ".join(text)
        else:
            docs[i] = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 300)))
    docs |= {200: "", 201: " \t\n", 202: None, 203: "One two", 204: "ONE\tTWO", 205: "Ünï x y z", 206: "long " * 30_000}
    df = spark.createDataFrame(list(docs.items()), SCHEMA).withColumn("lang", F.lit("x")).withColumn("fp", F.lit(1))
    prints = {i: brute_fingerprint(t) for i, t in docs.items()}
    expected = brute_components(prints, 2)
    assert sorted(rows(simhash.near_duplicates(df))) == sorted((i, f"{prints[i]:016x}", expected[i]) for i in docs)


@pytest.mark.parametrize("bits, list_pairs", [(0, 64), (1, 1), (2, 1), (2, 64), (3, 64), (4, 64)])
def test_links_in_dense_groups(spark, bits, list_pairs):
    """Chains and clouds of fingerprints around a few centres, in short lists and in lists that are split."""
    rng = np.random.default_rng(3)
    values = set()
    for centre in rng.integers(0, 2**63, 4):
        now = int(centre)
        for _ in range(40):
            values.add(now)
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                now ^= 1 << int(b)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = sorted(rows(simhash.links(df, bits, list_pairs=list_pairs)))
    assert found == [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= bits]


def test_one_fingerprint_on_most_rows(spark):
    """A hot fingerprint is joined by broadcast, with the same result."""
    docs = [(i, "same words here" if i % 3 else f"other {i % 50} text {i % 50} here") for i in range(3000)]
    found = rows(simhash.near_duplicates(spark.createDataFrame(docs, SCHEMA)))
    prints = {t: brute_fingerprint(t) for _, t in docs}
    expected = brute_components({i: p for p, i in {prints[t]: i for i, t in reversed(docs)}.items()}, 2)
    first = {prints[t]: i for i, t in reversed(docs)}
    assert sorted(found) == [(i, f"{prints[t]:016x}", expected[first[prints[t]]]) for i, t in docs]


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 600)] + [(7, 7), (3, 2)]
    found = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    assert found == {i: 0 for i in range(101)} | {i: 500 for i in range(500, 600)}
    assert rows(components(spark.createDataFrame([], "a long, b long"))) == []


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows(simhash.near_duplicates(empty)) == []
    assert rows(exact_dedup.DigestIndex(spark).deduplicate(empty)) == []


def test_exact_groups(spark):
    docs = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "a "), (None, "n"), (7, "x" * 500_000), (8, "x" * 500_000), (9, "r"), (9, "r")]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("keep_id", F.lit("clash")).withColumn("digest", F.lit("clash"))
    found = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.DigestIndex(spark).deduplicate(df).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert found[1, sha("a")]["keep_id"] == 3 and not found[1, sha("a")]["kept"] and found[3, sha("a")]["kept"]
    assert found[4, sha("")]["keep_id"] == 5 and found[6, sha("a ")]["kept"]
    assert found[None, sha("n")]["kept"] and found[7, sha("x" * 500_000)]["group_size"] == 2
    assert found[9, sha("r")]["group_size"] == 2 and found[9, sha("r")]["kept"]


def test_hot_groups_take_the_broadcast_way_with_the_same_result(spark):
    docs = [(i, "hot" if i % 3 else f"t{i % 50}") for i in range(600)]
    df = spark.createDataFrame(docs, SCHEMA)
    split = rows(exact_dedup.DigestIndex(spark).deduplicate(df, hot_groups=5))
    whole = rows(exact_dedup.DigestIndex(spark).deduplicate(df, hot_groups=10**6))
    assert sorted(split) == sorted(whole) and len(split) == 600


def test_index_persists(spark):
    index = exact_dedup.DigestIndex(spark)
    index.deduplicate(spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)).collect()
    later = exact_dedup.DigestIndex(spark, index.name).deduplicate(spark.createDataFrame([(10, "a"), (11, "c"), (12, "c")], SCHEMA))
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in later.collect()} == {(10, 1, False), (11, 12, False), (12, 12, True)}
    assert index.seen().count() == 3
    index.drop()
    assert exact_dedup.DigestIndex(spark, index.name).seen().count() == 0


def test_index_has_buckets_for_its_size_and_one_file_each(spark):
    index = exact_dedup.DigestIndex(spark, bucket_rows=100)
    index.deduplicate(spark.createDataFrame([(i, f"t{i}") for i in range(1000)], SCHEMA).repartition(7)).collect()
    assert index.bucket_count(0) == 10 and len(spark.table(index.name).inputFiles()) == 10
    index.deduplicate(spark.createDataFrame([(i, f"u{i}") for i in range(500)], SCHEMA).repartition(7)).collect()
    assert index.bucket_count(0) == 10 and len(spark.table(index.name).inputFiles()) == 20 and index.seen().count() == 1500
    index.drop()


def test_queries_leave_no_table_behind(spark):
    before = {t.name for t in spark.catalog.listTables()}
    exact_dedup.find_exact_duplicates(spark.createDataFrame([(1, "a"), (2, "a")], SCHEMA)).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_dropping_keeps_columns_and_one_of_each(spark):
    df = spark.createDataFrame([(1, "a b c d", "en"), (2, "a b c d", "en"), (3, "z", None)], SCHEMA + ", lang string")
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(df).collect()) == [2, 3]
    near = simhash.drop_near_duplicates(df)
    assert near.columns == df.columns and sorted(r["doc_id"] for r in near.collect()) == [1, 3]


def test_rows_of_one_id_with_several_texts(spark):
    """Rows go by their text, so that a text that no other row has stays whatever its id."""
    words = lambda n, k: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(5, words(40, 1)), (9, words(40, 1)), (5, words(40, 2)), (3, words(39, 2) + " other"), (None, words(40, 1)), (7, words(40, 3)), (7, words(40, 3))]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = lambda d: sorted(((r["doc_id"] or 0, r["text"][:4]) for r in d.collect()))
    assert kept(exact_dedup.drop_exact_duplicates(df)) == [(0, "w1x0"), (3, "w2x0"), (5, "w2x0"), (7, "w3x0"), (7, "w3x0"), (9, "w1x0")]
    assert kept(simhash.drop_similar(df)) == [(0, "w1x0"), (3, "w2x0"), (5, "w1x0"), (7, "w3x0"), (7, "w3x0")]
    assert (5, "w1x0") in kept(simhash.drop_near_duplicates(df)) and (9, "w1x0") not in kept(simhash.drop_near_duplicates(df))
