import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import common, exact_dedup, simhash

SCHEMA = "doc_id long, text string"
BITS = int(256 * np.arccos(0.8) / np.pi)


def decisive(text, size=5):
    words = np.array([xxhash.xxh64_intdigest(w, 42) for w in text.lower().encode().split()], np.uint64)
    return np.frombuffer(simhash.long_fingerprint(simhash.shingle_hashes(words, size)), np.uint8)


def classes(texts):
    """Brute force: all pairs within BITS bits."""
    ids = sorted(texts)
    prints = np.array([decisive(texts[i]) for i in ids])
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = []
    for k, i in enumerate(ids):
        apart = np.bitwise_count(prints[k + 1 :] ^ prints[k]).sum(axis=1)
        for j in np.flatnonzero(apart <= BITS):
            pairs.append((i, ids[k + 1 + int(j)]))
            x, y = find(i), find(pairs[-1][1])
            root[max(x, y)] = min(x, y)
    return pairs, {i: find(i) for i in ids}


def corpus(seed, originals, copies, rate):
    rng = np.random.default_rng(seed)
    words = np.array(["".join("abcdefghijklmnop"[k] for k in rng.integers(0, 16, rng.integers(2, 9))) for _ in range(4000)])
    base = [list(rng.choice(words, rng.integers(60, 400))) for _ in range(originals)]
    texts = [" ".join(b) for b in base]
    for n in range(copies):
        edited = [str(rng.choice(words)) if rng.random() < rate * rng.random() else w for w in base[n % 7 if n % 2 else 0]]
        texts.append(" ".join(edited))
    return dict(enumerate(texts))


def test_long_fingerprint_equals_direct_counts():
    hashes = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    got = np.unpackbits(np.frombuffer(simhash.long_fingerprint(np.concatenate([hashes, hashes[:100]])), np.uint8))
    counts = np.zeros(256)
    for h in hashes.tolist():
        for k in range(4):
            x = (h ^ (0x9E3779B97F4A7C15 * (k + 1) % 2**64)) * 0xBF58476D1CE4E5B9 % 2**64
            x = (x ^ x >> 29) * 0x94D049BB133111EB % 2**64
            x ^= x >> 32
            counts[64 * k : 64 * k + 64] += [x >> (8 * (b // 8) + 7 - b % 8) & 1 for b in range(64)]
    assert (got == (2 * counts > len(hashes))).all()


def test_recall_against_all_pairs(spark, monkeypatch):
    """A crowd of some hundred copies of one text, small groups, and texts of their own, lists short and split."""
    texts = corpus(5, 150, 300, 0.07)
    pairs, expected = classes(texts)
    df = spark.createDataFrame(list(texts.items()), SCHEMA)
    for few in (4, 32):
        monkeypatch.setattr(simhash, "FEW", few)
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
        assert len(pairs) > 1000 and np.mean([got[a] == got[b] for a, b in pairs]) >= 0.9
        assert all(expected[i] == expected[c] for i, c in got.items())  # no link that all pairs lack


@pytest.mark.parametrize("parts", [1, 5])
def test_no_pair_that_the_index_misses_is_left_apart(spark, monkeypatch, parts):
    """Pairs at the limit, of which the index meets a part, in one block and in several: classes equal all pairs'."""
    for name, value in {"KEYS": 2, "CENTRE_KEYS": 1, "PARTS": parts, "FEW_NODES": 8}.items():
        monkeypatch.setattr(simhash, name, value, raising=False)
    texts = corpus(9, 60, 120, 0.09)
    pairs, expected = classes(texts)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(list(texts.items()), SCHEMA)).collect()}
    assert len(pairs) > 40 and got == expected
    kept = {r["doc_id"] for r in simhash.drop_similar(spark.createDataFrame(list(texts.items()), SCHEMA)).collect()}
    assert kept == set(expected.values())


def test_similarity_of_edits(spark):
    """Copies with a word in fifty changed are caught, texts that share a passage are not."""
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(3000)]
    base = [str(w) for w in rng.choice(words, 300)]
    copy = [w if k % 50 else "changed" for k, w in enumerate(base)]
    partly = base[:120] + [str(w) for w in rng.choice(words, 180)]
    rows = [(1, " ".join(base)), (2, " ".join(copy).upper()), (3, " ".join(partly)), (4, None), (5, ""), (6, " ".join(base)), (None, " ".join(base)), (7, "one"), (8, "ONE"), (9, "word " * 200_000)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 1, None: 1, 7: 7, 8: 7, 9: 9}
    kept = simhash.drop_similar(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 7, 9]
    assert simhash.similar_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_crowds_of_the_same_words_in_other_orders(spark):
    """One vocabulary, a third of the texts near copies of another: the single words tell none apart."""
    rng = np.random.default_rng(4)
    vocabulary = np.array([f"w{k}" for k in range(120)])
    texts = {}
    for k in range(120):
        words = rng.permutation(vocabulary)
        texts[k] = " ".join(words)
        if k % 2:
            words = words.copy()
            words[5], words[6] = words[6], words[5]
            texts[1000 + k] = " ".join(words)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(list(texts.items()), SCHEMA)).collect()}
    assert sum(got[1000 + k] == k for k in range(1, 120, 2)) >= 54
    assert all(got[k] == k for k in range(120))


def test_no_pair_of_a_long_list_is_missed(spark, monkeypatch):
    """Chains of near copies in one vocabulary, all in the same lists: ends and middles of a chain are linked to their
    neighbours only, so whoever meets a centre alone loses links. Blocks are far shorter than the lists."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(8)
    vocabulary = np.array([f"w{k}" for k in range(150)])
    texts = {}
    for chain in range(8):
        words = rng.permutation(vocabulary)
        for step in range(12):
            texts[100 * chain + step] = " ".join(words)
            words = words.copy()
            at = rng.integers(0, 140, 2)
            words[at], words[at + 7] = words[at + 7], words[at].copy()
    pairs, expected = classes(texts)
    assert len(pairs) > 80 and 8 < len(set(expected.values())) < 60
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(list(texts.items()), SCHEMA)).collect()}
    assert got == expected


def test_tasks_of_the_index_post_few_rows(spark, monkeypatch):
    """Each task of the index gets about TASK_ROWS fingerprints, however few files they would fit in."""
    monkeypatch.setattr(simhash, "TASK_ROWS", 16, raising=False)
    dealt, plain = [], simhash.write

    def spy(df):
        done = plain(df)
        if set(df.columns) == {"node", "fp", "component"}:
            dealt.extend(r["n"] for r in done.df.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect())
        return done

    monkeypatch.setattr(simhash, "write", spy)
    texts = corpus(6, 200, 0, 0)
    assert simhash.similar_documents(spark.createDataFrame(list(texts.items()), SCHEMA)).count() == 200
    assert sum(dealt) == 200 and len(dealt) >= 10 and max(dealt) <= 40


def test_stages_of_the_pipeline_pass_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(i, "some words") for i in range(2500)], SCHEMA).coalesce(1)
    try:
        corpus_pipeline.near_duplicates(spark, docs.limit(1), "")
        sizes = docs.mapInArrow(lambda batches: (b.slice(0, 1).set_column(0, "doc_id", pa.array([b.num_rows])) for b in batches), SCHEMA)
        assert [r["doc_id"] for r in sizes.collect()] == [1000, 1000, 500]
    finally:
        spark.conf.set(name, before)


def test_chunks_of_texts_keep_rows_and_order():
    texts = [None, "", "abc", "x" * 50, "de", "", None, "f"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["doc_id", "text"])
    for limit in (0, 1, 3, 60):
        chunks = list(common.text_chunks(iter([batch]), limit=limit))
        assert [t for _, ts in chunks for t in ts] == [(t or "").encode() for t in texts]
        assert [i for b, _ in chunks for i in b.column("doc_id").to_pylist()] == list(range(8))
        assert all(b.num_rows == len(ts) for b, ts in chunks)


@pytest.mark.parametrize("most", [2, 1 << 18])
def test_dropped_rows_are_broadcast_up_to_a_bound(spark, monkeypatch, most):
    """Texts are not shuffled to drop a few of them; beyond the bound they are, and the same rows go."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", most, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(i, f"text {i % 4}") for i in range(12)] + [(None, "text 1"), (3, "other")], SCHEMA)
        gone = [(1, "text 1"), (2, "text 2"), (3, "text 3")]
        kept = simhash.without(docs, simhash.keyed(spark.createDataFrame(gone, SCHEMA)))
        exact = exact_dedup.drop_exact_duplicates(docs)
        for df in (kept, exact):
            assert ("BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()) == (most > 2)
        assert sorted(tuple(r) for r in kept.where("doc_id < 4").collect()) == [(0, "text 0"), (3, "other")]
        assert sorted((r["doc_id"] or -1, r["text"]) for r in exact.collect()) == [(-1, "text 1"), (3, "other"), (8, "text 0"), (9, "text 1"), (10, "text 2"), (11, "text 3")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pipeline_against_brute_force(spark):
    """run() on the smallest tables, stage by stage: what each keeps, worked out again without Spark's joins."""
    from tablewright.llm import language, packing, queries, toxicity

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(docs)
    model = queries.language_model(spark, sf)
    ids = [i for i, r in zip(ids, language.infer(model, [docs[i].encode() for i in ids])) if r[0] != "und"]
    scores = toxicity.score_texts(queries.toxicity_model(spark, sf), [docs[i].encode() for i in ids])
    ids = [i for i, s in zip(ids, scores) if s < 0.3]
    last = {docs[i]: i for i in ids}
    ids = [i for i in ids if last[docs[i]] == i]
    expected = classes({i: docs[i] for i in ids})[1]
    ids = [i for i in ids if expected[i] == i]
    words = packing.WordTable(queries.tokenizer_path("word_bpe_49k.json"))
    tokens = {i: len(x) + 1 for i, x in zip(ids, words.encode([docs[i].encode() for i in ids]))}
    found = corpus_pipeline.run(spark, sf).collect()
    kept = {r["doc_id"] for r in found}
    near = sum(expected[i] != i for i in expected)
    assert near > 5 and kept >= set(ids) and len(kept - set(ids)) <= max(2, 0.1 * near)  # the index may miss a link
    assert all(sum(r["length"] for r in found if r["doc_id"] == i) == tokens[i] for i in ids)
    assert len({r["sequence_id"] for r in found}) == -(-sum(r["length"] for r in found) // 4096)
