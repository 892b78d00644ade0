import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tablewright.llm import packing, sentencepiece

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["It's a test, don't <|endoftext|> x", "<|ENDOFTEXT|> 12.5% (abc)!", "", " \n\x1c a\x1cb \x85", "é, É— é! ×2 ÷ 3ªº a×b œuvre Σας ΣΑΣ", "a\x00b", "ﬁ ½ a̧,b ǅ", "x̸= y", "a b　c", "日本語 テスト", "we'll WE'LL 'S"]


def test_ids_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(TOKENIZER)
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + ODD
    table = packing.WordTable(TOKENIZER, most=2000)
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        assert [x.tolist() for x in table.encode([t.encode() for t in part])] == [reference.encode(t, add_special_tokens=False).ids for t in part]


def test_packing_is_whole_and_tight(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit("clash").alias("piece"), F.lit(1).alias("shard"))
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 9000), (5, "again"), (None, "no id")], "doc_id long, text string").withColumn("piece", F.lit("clash")).withColumn("shard", F.lit(1))
    found = packing.pack(docs.unionByName(extra), TOKENIZER).collect()
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    total = sum(r["length"] for r in found)
    assert len(by_sequence) == -(-total // 4096)
    long = sorted((r["piece"], r["start"], r["length"]) for r in found if r["doc_id"] == -3)
    assert long == [(0, 0, 4096), (1, 4096, 4096), (2, 8192, 809)]
    one = zlib.crc32(np.array([1], "<u4").tobytes())
    assert [(r["length"], r["ids_crc32"]) for r in found if r["doc_id"] in (-1, -2)] == [(1, one)] * 2
    few = packing.pack(extra, TOKENIZER, max_documents=2).groupBy("sequence_id").count().collect()
    assert max(r["count"] for r in few) == 2
    assert sum(r["doc_id"] is None for r in found) == 1 and packing.pack(extra.limit(0), TOKENIZER).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_holds_every_capacity(rule):
    rng = np.random.default_rng(1)
    length = np.sort(rng.integers(1, 4097, 3000))[::-1].astype(float)
    demand = np.column_stack([length, np.ones(len(length)), length**2])
    capacity = np.array([4096.0, 3.0, 4096.0**2])
    bins = packing.best_fit(demand, capacity, np.array([1.0, 0.2, 0.2]), rule)
    used = np.array([np.bincount(bins, d) for d in demand.T]).T
    assert (used <= capacity).all()
    lower = max(np.ceil(demand.sum(axis=0) / capacity))
    assert bins.max() + 1 <= 1.15 * lower


def test_best_fit_takes_the_tightest_bin():
    demand = np.array([[6.0], [5.0], [4.0], [5.0]])
    assert packing.best_fit(demand, np.array([10.0]), np.array([1.0])).tolist() == [0, 1, 0, 1]


def brute_best_fit(demand, capacity, weights, rule):
    rooms, bins = [], []
    for d in demand:
        ways = []
        for k, room in enumerate(rooms):
            if all(r >= x for r, x in zip(room, d)):
                left = [(r - x) / c for r, x, c in zip(room, d, capacity)]
                dot = sum(w * (x / c) * (r / c) for w, x, r, c in zip(weights, d, room, capacity))
                ways.append((sum(w * v * v for w, v in zip(weights, left)) if rule == "norm" else -dot, k))
        if not ways:
            rooms.append(list(capacity))
            ways = [(0, len(rooms) - 1)]
        k = min(ways)[1]
        rooms[k] = [r - x for r, x in zip(rooms[k], d)]
        bins.append(k)
    return bins


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity, binding", [((64, 64, 4096), [0]), ((64, 4, 4096), [0, 1]), ((64, 64, 2048), [0, 2]), ((64, 8, 2048), [0, 1, 2])])
def test_bins_equal_brute_force_whichever_capacities_bind(rule, capacity, binding):
    """Powers of two make all scores exact, so ties fall alike."""
    length = np.sort(np.random.default_rng(6).integers(1, 41, 400))[::-1].astype(float)
    demand = np.column_stack([length, np.ones(400), length**2])
    got = packing.best_fit(demand, np.array(capacity, float), np.ones(3), rule)
    assert got.tolist() == brute_best_fit(demand.tolist(), capacity, [1.0, 1.0, 1.0], rule)
    used = np.array([np.bincount(got, d) for d in demand.T]).T
    assert (used <= capacity).all() and (used == capacity).any(axis=0).nonzero()[0].tolist() == binding


def brute_segment(pieces, scores, word, unknown):
    best = {0: (0.0, [])}
    for end in range(1, len(word) + 1):
        ways = []
        for start in range(max(0, end - 16), end):
            p = word[start:end]
            if p in pieces:
                ways.append((best[start][0] + scores[pieces[p]], -start, best[start][1] + [pieces[p]]))
        if word[end - 1] not in pieces:
            ways.append((best[end - 1][0] + unknown, -(end - 1), best[end - 1][1] + [f"<{word[end - 1]}>"]))
        best[end] = max(ways, key=lambda w: (w[0], w[1]))[0], max(ways, key=lambda w: (w[0], w[1]))[2]
    return best[len(word)][1]


def test_segmentation_equals_brute_force_and_the_library():
    import sentencepiece as library
    from sentencepiece import sentencepiece_model_pb2 as pb

    found = sentencepiece.Pieces.load(MODEL)
    model = library.SentencePieceProcessor(model_file=MODEL)
    pieces = {model.id_to_piece(i): i for i in found.ids.tolist()}
    scores = {i: model.get_score(i) for i in pieces.values()}
    rng = random.Random(2)
    words = ["▁" + "".join(rng.choice("etaoinshrdlucmé日x") for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    encoder = sentencepiece.Encoder(found)
    ids = encoder.encode([w[1:] for w in words])
    for w, got in zip(words, ids):
        want = brute_segment(pieces, scores, w, found.unknown)
        flat = [i for x in want for i in ([x] if isinstance(x, int) else [found.byte_ids[b] for b in x[1:-1].encode()])]
        assert got == flat
    proto = pb.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    unigram = library.SentencePieceProcessor(model_proto=proto.SerializeToString())
    known = [w[1:] for w in words if all(c in pieces for c in w)]
    assert encoder.encode(known) == unigram.encode(known)


def test_round_trip(spark):
    texts = [(1, "The theory of  everything\n日本𝛀 x "), (2, ""), (3, None), (4, "a" * 3000), (5, " lead"), (5, " lead"), (None, "\t é")] + [(10 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    found = sentencepiece.encode(df, MODEL).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"]) for r in found) == sorted((i or 0, t or "") for i, t in texts)
    assert sentencepiece.encode(df.limit(0), MODEL).count() == 0
