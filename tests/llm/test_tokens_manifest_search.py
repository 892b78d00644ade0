import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewright.llm import lexical, manifest, queries, tokens
from tablewright.llm.common import numbered

BYTE_BPE, WORD_BPE, PIECES = (queries.tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
PLACES = ["a", "b ", "'s", "é", "中", " ", "  ", "\n", "\t", "\r\n", " ", "　", " ", "\x1c", "\x85", "​", "1", "٣", ".", "!", "<|endoftext|>", " <|endoftext|> ", "\U0001f600"]


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PLACES) for _ in range(rng.randrange(30))) for _ in range(n)]


# --- token counts -----------------------------------------------------------------


def whole(path, some):
    if path.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(some)]
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE, PIECES])
def test_counts_equal_the_library(spark, path):
    some = texts(1, 3000) + ["", "word " * 30_000, "x" * 5000, " " * 5000 + "y", "中" * 4000, "a\n\n b" * 2000]
    rows = [(i, t) for i, t in enumerate(some)]
    df = spark.createDataFrame(rows + rows[:5] + [(None, "one two"), (-1, None)], "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).repartition(3)
    got = Counter(tuple(r) for r in tokens.count_tokens(df, path, limit=50).collect())
    expected = whole(path, some)
    counts = [(i, len(t.encode()), n, n > 50) for (i, t), n in zip(rows, expected)]
    two = whole(path, ["one two"])[0]
    assert got == Counter(counts + counts[:5] + [(None, 7, two, False), (-1, 0, 0, False)])
    assert tokens.count_tokens(df.limit(0), path).count() == 0


def test_units_join_and_forgotten_units_are_counted_again():
    some = texts(2, 500)
    assert all(b"".join(tokens.units(t.encode())) == t.encode() for t in some)
    counter = tokens.Lengths(BYTE_BPE, most=5, keep=4, batch_bytes=64)
    for at in range(0, 500, 50):
        assert counter.count([t.encode() for t in some[at : at + 50]]) == whole(BYTE_BPE, some[at : at + 50])
    assert max(map(len, counter.known)) <= 4


def test_query_counts_every_document(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    expected = dict(zip(docs, whole(BYTE_BPE, [t or "" for t in docs.values()])))
    got = {r["doc_id"]: (r["n_tokens"], r["over_limit"]) for r in queries.op11_token_counts(spark, sf).collect()}
    assert got == {k: (n, n > 1024) for k, n in expected.items()}


# --- manifest ---------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(hashes, fanout):
    """The root and, for every leaf, its (siblings to the left, to the right) level by level."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for leaf, k in enumerate(at):
            first = k // fanout * fanout
            paths[leaf].append(("".join(level[first:k]), "".join(level[k + 1 : first + fanout])))
            at[leaf] = k // fanout
        level = [sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], paths


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest_equals_brute_force(spark, fanout):
    rng = random.Random(fanout)
    docs = [(i, rng.choice(["a", "b", "é", None, ""]), rng.choice(["X y", None, "", "Z" * 2000])) for i in range(90)] + [(1000 + i, "hot", f"T{i}") for i in range(17 * 17)]
    docs += docs[:7] + [(None, "a", "Q"), (5000, "alone", "w"), (5, "a", "another")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("leaf", F.lit("clash")).withColumn("place", F.lit(1)).repartition(5)
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf_of = lambda d, s, t: sha(field(d) + field(s) + field(t))
    changed = lambda d, t: d is not None and zlib.crc32(str(d).encode()) % 5 == 0
    lower = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
    groups = {}
    for d, s, t in docs:
        groups.setdefault(s, []).append((d is not None, d or 0, leaf_of(d, s, t), d, s, t))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: brute_tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], fanout) for s in names}
    root, tops = brute_tree([subs[s][0] for s in names], fanout)
    expected = Counter()
    for k, s in enumerate(names):
        for x, path in zip(sorted(groups[s], key=lambda x: x[:3]), subs[s][1]):
            full = path + tops[k]
            now = leaf_of(x[3], s, lower(x[5])) if changed(x[3], x[5]) else x[2]
            for left, right in full:
                now = sha(left + now + right)
            expected[x[3], x[2], subs[s][0], root, sha("".join(a + b for a, b in full)), now] += 1
    of = lambda text: manifest.leaf(F.col("doc_id"), F.col("source"), text)
    claimed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, of(F.translate("text", queries.A_TO_Z, queries.LOWER)))
    found = manifest.manifest(df, of(F.col("text")), claims=[("claimed", claimed)], fanout=fanout)
    rows = found.select("doc_id", "leaf", "subroot", "root", manifest.proof_hash(F.col("path")), manifest.fold(F.coalesce("claimed", "leaf"), F.col("path")))
    assert Counter(tuple(r) for r in rows.collect()) == expected


def test_manifest_of_one_and_of_none(spark):
    df = spark.createDataFrame([(1, None, "t")], "doc_id long, source string, text string")
    one = manifest.manifest(df, manifest.leaf(F.col("text"))).first()
    assert one["leaf"] == one["subroot"] == one["root"] == sha("1:t") and one["path"] == []
    assert manifest.manifest(df.limit(0), manifest.leaf(F.col("text"))).count() == 0


def test_numbering_of_one_large_group(spark):
    rows = spark.range(50_000).select(F.lit("g").alias("tree"), (F.col("id") * 7919 % 50_000).alias("key")).unionByName(spark.range(3).select(F.lit("h").alias("tree"), F.lit(1).cast("long").alias("key")))
    got = numbered(rows, "tree", ["key"])
    assert got.where("tree = 'g' AND place <> key").isEmpty() and sorted(r["place"] for r in got.where("tree = 'h'").collect()) == [0, 1, 2]
    assert {r["size"] for r in got.select("size").distinct().collect()} == {50_000, 3}


# --- ranked search ----------------------------------------------------------------


def brute_rank(docs, items, k):
    find = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(d, c) for d, t in docs if (c := Counter(find(t)))]
    total, occurrences = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in sorted(set(items), key=str):
        asked.setdefault(i, []).extend(find(t))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, c in counts:
            m = 75 + 25 * c.total() * total // occurrences
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_terms", [500_000, 40])
def test_ranks_equal_brute_force(spark, block_terms, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 200)
    rng = random.Random(9)
    words = ["Alpha", "beta", "été", "x1", "中文", "the", "The", "a b", "zq"] + [f"w{k}" for k in range(60)]
    make = lambda n: rng.choice(" ,.;\n").join(rng.choice(words) for _ in range(rng.randrange(n)))
    docs = [(i, make(80)) for i in range(300)] + [(900 + i, "alpha beta the") for i in range(40)] + [(3, "again alpha"), (None, "alpha beta the"), (None, "alpha"), (700, None), (701, ""), (702, "...")]
    items = [(i, make(20)) for i in range(25)] + [(30, "alpha beta"), (30, "alpha beta"), (31, None), (32, "the the the"), (33, "nowhere"), (34, "alpha"), (34, "beta"), (None, "x1 beta")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).repartition(6)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    got = sorted((tuple(r) for r in lexical.rank(df, asked, 20, block_terms).collect()), key=str)
    assert got == brute_rank(docs, items, 20)
    assert lexical.rank(df.limit(0), asked).count() == 0 and lexical.rank(df, asked.limit(0)).count() == 0


def test_long_texts_are_counted_by_windows(monkeypatch):
    text = ("One twoé " * 500 + "x" * 300 + ",").encode()
    expected = lexical.term_counts(text)
    monkeypatch.setattr(lexical, "WINDOW", 50)
    assert lexical.term_counts(text) == expected and expected[b"one"] == 500


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_ranked_search"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    engine = duckdb.connect()
    for t in ("documents", "benchmark"):
        engine.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    result = engine.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(map(str, result.fetchall())) == sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, sf).select(*columns).collect())
