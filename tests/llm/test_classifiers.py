import zlib

import numpy as np
from pyspark.sql import functions as F

from tablewright.llm import language, queries, toxicity

SF = "/root/testdata/sf0.01"
EDGES = [(1, None), (2, ""), (3, "123 !?"), (4, "the and of " * 20_000), (None, "the and of"), (6, "la de que"), (6, "la de que")]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("weights", F.lit(1)).withColumn("lang", F.lit("zz"))


def test_language_held_out_accuracy(spark):
    found = queries.op9_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(found) == 1000 and all(r["held_out"] for r in held)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97


def test_language_edges(spark):
    model = queries.language_model(spark, SF)
    got = language.identify(docs(spark, EDGES), model)
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert [by_id[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and by_id[4]["lang_pred"] == "en" and by_id[None]["lang_pred"] == "en"
    assert got.count() == len(EDGES) and language.identify(docs(spark, EDGES).limit(0), model).count() == 0
    kept = language.keep_identified(docs(spark, EDGES), model)
    assert kept.columns == docs(spark, EDGES).columns and kept.count() == 4
    nothing = language.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in language.identify(docs(spark, EDGES), nothing).collect()} == {"und"}


def test_mixture_finds_both_languages(spark):
    model = queries.language_model(spark, SF)
    texts = {r["lang"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 3000 and lang in ('en', 'de')").collect()}
    both = (texts["en"][:3000] + " " + texts["de"][:1500]).encode()
    (lang, score, all_), = language.infer(model, [both])
    assert lang == "en" and {x for x, _ in all_} == {"en", "de"} and 0.5 < score < 0.8


def test_mixture_finds_more_than_three_languages():
    names = ["aa", "bb", "cc", "dd", "ee"]
    text = {lang: " ".join(lang[0] * n + lang for n in range(1, 9)) + " " for lang in names}
    table = np.full((language.BUCKETS, 5), 0.1)
    for j, lang in enumerate(names):
        table[:, j] += np.bincount(language.words([text[lang].encode()])[0], minlength=language.BUCKETS) * 100
    model = language.Model(names, np.log(table / table.sum(axis=0)).astype(np.float32))
    mixed = (text["aa"] * 40 + text["bb"] * 30 + text["cc"] * 20 + text["dd"] * 10).encode()
    many, one = language.infer(model, [mixed, text["ee"].encode() * 9])
    assert [x for x, _ in many[2]] == names[:4] and np.allclose([p for _, p in many[2]], [0.4, 0.3, 0.2, 0.1], atol=0.01) and abs(many[1] - 0.4) < 0.01
    assert one[0] == "ee" and len(one[2]) == 1


def random_model(langs, seed=0):
    rng = np.random.default_rng(seed)
    table = rng.gamma(0.05, size=(language.BUCKETS, len(langs))) + 1e-4
    return language.Model(langs, np.log(table / table.sum(axis=0)).astype(np.float32))


def test_inferred_sets_equal_brute_force():
    """Every set of languages, its proportions by long expectation-maximisation, the penalty as stated."""
    from itertools import combinations

    model = random_model(["aa", "bb", "cc", "dd"])
    rng = np.random.default_rng(2)
    vocabulary = ["".join("abcdefghij"[k] for k in rng.integers(0, 10, rng.integers(2, 8))) for _ in range(400)]
    of_word = np.array([model.logs[language.words([w.encode()])[0]].sum(axis=0) for w in vocabulary], float)
    by_lang = [[w for w, j in zip(vocabulary, of_word.argmax(axis=1)) if j == k] for k in range(4)]
    texts = [" ".join(rng.choice(by_lang[k]) for k in langs for _ in range(n)) for langs, n in (((0,), 30), ((1, 3), 25), ((0, 1, 2), 20), ((3, 2, 1, 0), 15), ((2,), 3))]
    for text, (lang, score, found) in zip(texts, language.infer(model, [t.encode() for t in texts], rounds=200)):
        logs = np.array([model.logs[language.words([w.encode()])[0]].sum(axis=0) for w in text.split()], float)
        likelihood = np.maximum(np.exp(logs - logs.max(axis=1, keepdims=True)), 1e-12)
        best = (-np.inf, None, None)
        for size in range(1, 5):
            for chosen in combinations(range(4), size):
                share = np.full(size, 1 / size)
                for _ in range(500):
                    weight = likelihood[:, chosen] * share
                    share = (weight / weight.sum(axis=1, keepdims=True)).mean(axis=0)
                value = np.log(likelihood[:, chosen] @ share).sum() - 3.0 * np.log(len(likelihood) + 1) * (size - 1)
                best = max(best, (value, chosen, share), key=lambda b: b[0])
        assert {x for x, _ in found} == {model.langs[j] for j in best[1]}
        assert np.allclose(sorted(p for _, p in found), np.sort(best[2]), atol=1e-3) and lang == model.langs[best[1][int(np.argmax(best[2]))]]


def test_many_languages_share_the_table(spark):
    """Over 64 languages the buckets are fewer; none is left out."""
    langs = [f"l{k:03d}" for k in range(150)]
    letters = lambda k: chr(0x4E00 + 7 * k) + chr(0x4E00 + 7 * k + 1) + chr(0x4E00 + 7 * k + 2)
    texts = [(k, " ".join([letters(k)] * 20), lang) for k, lang in enumerate(langs)]
    model = language.fit(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    assert model.langs == langs and len(model.logs) * 150 <= language.CELLS and model.shift == 2
    found = language.infer(model, [t.encode() for _, t, _ in texts])
    assert np.mean([r[0] == lang for r, lang in zip(found, langs)]) > 0.95


def test_documents_in_several_languages_stay(spark):
    model = queries.language_model(spark, SF)
    texts = {r["lang"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 3000").collect()}
    mixed = " ".join(texts[lang][:1000] for lang in ("en", "de", "fr", "es"))
    assert [r["doc_id"] for r in language.keep_identified(docs(spark, [(1, mixed), (2, "--"), (3, None)]), model).collect()] == [1]


def test_mixture_increases_likelihood_and_sums_to_one():
    rng = np.random.default_rng(0)
    likelihood = rng.random((50, 3)) + 1e-3
    starts, sizes = np.array([0, 20]), np.array([20, 30])
    one, fit1 = language.mixture(likelihood, starts, sizes, np.ones((2, 3)), 1)
    many, fit2 = language.mixture(likelihood, starts, sizes, np.ones((2, 3)), 30)
    assert np.allclose(many.sum(axis=1), 1) and (fit2 >= fit1).all()


def test_toxicity_held_out(spark):
    found = queries.op8_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r for r in found if r["toxic"] == 1]
    clean = [r for r in found if r["toxic"] == 0]
    score = lambda rows: np.array([r["score"] for r in rows])
    order = (score(toxic)[:, None] > score(clean)[None]).mean() + 0.5 * (score(toxic)[:, None] == score(clean)[None]).mean()
    assert order > 0.8 and np.mean([r["predicted"] for r in clean]) < 0.06


def test_toxicity_edges(spark):
    model = queries.toxicity_model(spark, SF)
    scored = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs(spark, EDGES), model).collect()}
    assert scored[1] == scored[2] and all(0 <= s <= 1 for s in scored.values())
    assert toxicity.keep_civil(docs(spark, EDGES), model).columns == docs(spark, EDGES).columns
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    empty = toxicity.fit(spark.createDataFrame([(1, "a")], "doc_id long, text string"), no_labels)
    assert len(empty.buckets) == 0 and (toxicity.score_texts(empty, [b"a", b""]) < 0.3).all()


def test_nn_pu_separates_and_the_risk_stays_non_negative():
    rng = np.random.default_rng(4)
    positive = [[0] + ([1] if rng.random() < 0.5 else []) for _ in range(60)]
    unlabelled = [[0] for _ in range(20)] + [[2] for _ in range(180)]
    weights, bias = toxicity.nn_pu_fit(positive, unlabelled, 3, 0.1)
    f = lambda r: bias + sum(weights[i] for i in r)
    assert f([0]) > f([2]) and f([0, 1]) > f([])
    high = [1 / (1 + np.exp(-f(r))) for r in unlabelled]
    assert abs(np.mean(high) - 0.1) < 1e-6 and 1 / (1 + np.exp(-f([0, 1]))) > 0.3 > 1 / (1 + np.exp(-f([2])))


def test_nn_pu_risk_and_gradient_equal_brute_force():
    import math

    rng = np.random.default_rng(1)
    positive, unlabelled = ([rng.choice(5, rng.integers(0, 4), replace=False).tolist() for _ in range(n)] for n in (7, 11))
    rows, w, prior = toxicity.Rows.of(positive, unlabelled), rng.normal(size=6), 0.2
    loss = lambda x: math.log1p(math.exp(-x))

    def parts(w):
        f = lambda r: w[5] + sum(w[i] for i in r)
        mean = lambda sign, group: sum(loss(sign * f(r)) for r in group) / len(group)
        return prior * mean(1, positive), mean(-1, unlabelled) - prior * mean(-1, positive)

    first, rest, first_g, rest_g = toxicity.nn_pu_risk(w, rows, prior)
    assert np.allclose((first, rest), parts(w))
    for i in range(6):
        step = np.eye(6)[i] * 1e-6
        slopes = (np.array(parts(w + step)) - parts(w - step)) / 2e-6
        assert np.allclose(slopes, (first_g[i], rest_g[i]), atol=1e-6)


def test_clean_labels_make_no_difference(spark):
    """Only confirmed toxic rows, unlabelled text and the class prior are learnt from."""
    texts = spark.createDataFrame([(i, f"vile filth {i}" if i % 4 == 0 else f"fair words {i}") for i in range(200)], "doc_id long, text string")
    labels = [(i, 1) for i in range(0, 80, 4)]
    models = [toxicity.fit(texts, spark.createDataFrame(labels + [(i + k, 0) for i in range(1, 241, 4)], "doc_id long, toxic int"), least_evidence=10.0) for k in (0, 1)]
    assert models[0].bias == models[1].bias and (models[0].weights == models[1].weights).all() and models[0].prior == 0.25
    assert (toxicity.score_texts(models[0], [b"vile filth", b"fair words"]) > 0.3).tolist() == [True, False]


def test_columns_of_the_same_names_give_way(spark):
    clash = docs(spark, EDGES).withColumn("toxicity", F.lit("x")).withColumn("score", F.lit("y")).withColumn("lang_pred", F.lit("z"))
    scored = toxicity.score(clash, queries.toxicity_model(spark, SF))
    assert scored.count() == len(EDGES) and dict(scored.dtypes)["toxicity"] == "double" and dict(scored.dtypes)["score"] == "string"
    found = language.identify(clash, queries.language_model(spark, SF))
    assert found.count() == len(EDGES) and dict(found.dtypes)["score"] == "double" and dict(found.dtypes)["toxicity"] == "string"
