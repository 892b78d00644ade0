"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import audio, exact_dedup, html, language, lexical, manifest, packing, sentencepiece, sharding, simhash, tokens, toxicity, warc
from tablewright.llm.common import fold, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, seed=42, max_bits=2)


def op3_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recordings are the documents' UTF-8 bytes as 8-bit PCM at 8 kHz, the only sound that the tables hold."""
    docs = table(spark, sf_dir, "documents")
    return audio.align(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("audio")))


SHARDS = [f"shard-{k:02d}" for k in range(64)]


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", SHARDS).select("doc_id", "slot", "shard")


OP4_SQL = """
WITH RECURSIVE sizes AS (SELECT 6421 AS size, 64 AS n),
shards AS (
    SELECT k, 'shard-' || lpad(k::VARCHAR, 2, '0') AS shard,
           ('0x' || substr(md5('shard-' || lpad(k::VARCHAR, 2, '0')), 1, 15))::BIGINT % 6421 AS start,
           ('0x' || substr(md5('shard-' || lpad(k::VARCHAR, 2, '0')), 16, 15))::BIGINT % 6420 + 1 AS step
    FROM range(64) AS r(k)),
claims AS (
    SELECT -1 AS turn, CAST(NULL AS BIGINT) AS slot, list_transform(range(6421), lambda x: false) AS taken
    UNION ALL
    SELECT turn, slot, taken[1:slot] || [true] || taken[slot + 2:]
    FROM (SELECT c.turn + 1 AS turn, c.taken,
                 list_filter(list_transform(range(6421), lambda j: (s.start + j * s.step) % 6421), lambda x: NOT c.taken[x + 1])[1] AS slot
          FROM claims c JOIN shards s ON s.k = (c.turn + 1) % 64
          WHERE c.turn + 1 < 6421) t),
filled AS (SELECT slot, shard FROM claims JOIN shards ON k = turn % 64 WHERE turn >= 0)
SELECT doc_id, slot::INTEGER AS slot, shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % 6421 AS slot FROM documents) d
JOIN filled USING (slot)
"""


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_exact_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = sentencepiece.encode(docs, tokenizer_path("piece_bpe_32k.model"))
    return found.select("doc_id", "ids", F.size("ids").alias("n_ids"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    seen = fold("doc_id", 4) != 2
    return toxicity.fit(table(spark, sf_dir, "documents").where(seen), table(spark, sf_dir, "labels").where(seen))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def language_model(spark: SparkSession, sf_dir: str) -> language.Model:
    return language.fit(table(spark, sf_dir, "documents").where(fold("doc_id", 3) != 1))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = language.identify(docs, language_model(spark, sf_dir))
    return found.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")


def op10_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as WARC files against a replica in which every page whose id leaves 5 modulo 97 has one byte changed
    or, for the empty ones, added, and every page whose id leaves 7 modulo 1009 is lost."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    damaged = F.concat(F.lit("#"), F.expr("substring(coalesce(html, ''), 2)"))
    replica = pages.where(~F.coalesce(F.col("page_id") % 1009 == 7, F.lit(False))).withColumn("html", F.when(F.col("page_id") % 97 == 5, damaged).otherwise(F.col("html")))
    return warc.audit(warc.page_records(pages), warc.page_records(replica))


OP10_SQL = """
WITH records AS (
    SELECT page_id, 'pages-' || (page_id // 1000)::VARCHAR || '.warc' AS file, page_id % 1000 AS position, coalesce(html, '') AS html,
           'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'
           || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' AS head
    FROM pages),
both_ AS (
    SELECT *, head || strlen(html) || repeat(chr(13) || chr(10), 2) || html || repeat(chr(13) || chr(10), 2) AS ours,
           '#' || substr(html, 2) AS changed FROM records),
sides AS (
    SELECT *, CASE WHEN page_id % 1009 = 7 THEN NULL
                   WHEN page_id % 97 = 5 THEN head || strlen(changed) || repeat(chr(13) || chr(10), 2) || changed || repeat(chr(13) || chr(10), 2)
                   ELSE ours END AS theirs FROM both_),
placed AS (
    SELECT *, sum(strlen(ours)) OVER w AS last, sum(strlen(theirs)) OVER w AS their_last FROM sides
    WINDOW w AS (PARTITION BY file ORDER BY position))
SELECT file, position, (last - strlen(ours))::BIGINT AS first, last::BIGINT AS last,
       CASE WHEN theirs IS NULL THEN 'missing' WHEN theirs = ours THEN 'moved' ELSE 'corrupt' END AS status,
       sha256(ours) AS primary_hash, sha256(theirs) AS replica_hash
FROM placed WHERE theirs IS DISTINCT FROM ours OR their_last <> last OR strlen(theirs) <> strlen(ours)
"""


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


A_TO_Z, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, and what a copy whose texts are lower-cased where 5 divides the id's crc32 would be verified as."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    of = lambda text: manifest.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.when(fold("doc_id", 5) == 0, of(F.translate("text", A_TO_Z, LOWER)))
    found = manifest.manifest(docs, of(F.col("text")), claims=[("claimed", tampered)])
    folded = found.withColumn("folded_root", manifest.fold(F.coalesce("claimed", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", manifest.proof_hash(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_sql(leaf_levels: int = 6, group_levels: int = 4) -> str:
    """Every level as a statement of its own: enough for 16 ** leaf_levels rows a source and 16 ** group_levels sources."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    parts = [f"""
steps AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) AS t),
hashed AS (
    SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf("text")} AS leaf,
           CASE WHEN xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT),
                                     lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0
                THEN {leaf(f"translate(text, '{A_TO_Z}', '{LOWER}')")} END AS claimed
    FROM documents, steps),
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size FROM hashed),
a0 AS (SELECT tree, place, size, leaf AS hash FROM leaves)"""]

    def levels(name: str, n: int) -> list[str]:
        out = []
        for k in range(n):
            out.append(f"{name}r{k} AS (SELECT tree, place // 16 AS run, string_agg(hash, '' ORDER BY place) AS members FROM {name}{k} WHERE size > 1 GROUP BY ALL)")
            out.append(f"""{name}{k + 1} AS (SELECT tree, 0 AS place, size, hash FROM {name}{k} WHERE size = 1
    UNION ALL SELECT tree, run, (s.size + 15) // 16, sha256(members) FROM {name}r{k} JOIN (SELECT tree, any_value(size) AS size FROM {name}{k} GROUP BY tree) s USING (tree))""")
        return out

    parts += levels("a", leaf_levels)
    parts.append(f"b0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size, hash, tree AS source_tree FROM a{leaf_levels})")
    parts += levels("b", group_levels)
    joins, siblings, folds = [], [], ["coalesce(claimed, leaf)"]
    for name, n, place in (("a", leaf_levels, "l.place"), ("b", group_levels, "g.place")):
        for k in range(n):
            alias, slot = f"{name}r{k}", f"({place} // {16**k}) % 16"
            tree = "l.tree" if name == "a" else "''"
            joins.append(f"LEFT JOIN {alias} ON {alias}.tree = {tree} AND {alias}.run = {place} // {16 ** (k + 1)}")
            left, right = f"substr({alias}.members, 1, 64 * ({slot}))", f"substr({alias}.members, 64 * ({slot}) + 65)"
            siblings.append(f"coalesce({left} || {right}, '')")
            folds.append((f"{alias}.members", left, right))
    chosen = ", ".join(f"{left} AS l{i}, {right} AS r{i}" for i, (_, left, right) in enumerate(folds[1:]))
    parts.append(f"""
paths AS (SELECT doc_id, leaf, g.hash AS subroot, (SELECT hash FROM b{group_levels}) AS root, sha256({" || ".join(siblings)}) AS proof_sha256, {folds[0]} AS h0, {chosen}
    FROM leaves l JOIN b0 g ON g.source_tree = l.tree {" ".join(joins)})""")
    for i in range(len(folds) - 1):
        parts.append(f"f{i} AS (SELECT *, coalesce(sha256(l{i} || h{i} || r{i}), h{i}) AS h{i + 1} FROM {'paths' if not i else f'f{i - 1}'})")
    last = len(folds) - 1
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, proof_sha256, h{last} AS folded_root, h{last} = root AS verified FROM f{last - 1}"


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


OP13_SQL = f"""
WITH words AS (
    SELECT *, regexp_extract_all(translate(text, '{A_TO_Z}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
    FROM (SELECT 'd' AS kind, doc_id AS id, text, row_number() OVER () AS r FROM documents
          UNION ALL SELECT 'i', item_id, text, row_number() OVER () FROM (SELECT DISTINCT item_id, text FROM benchmark))),
asked AS (SELECT id AS item_id, term, count(*) AS times FROM (SELECT id, unnest(terms) AS term FROM words WHERE kind = 'i') GROUP BY ALL),
docs AS (SELECT id AS doc_id, r, len(terms) AS n, terms FROM words WHERE kind = 'd' AND len(terms) > 0),
total AS (SELECT count(*) AS N_, sum(n)::BIGINT AS L_ FROM docs),
found AS (SELECT doc_id, r, n, term, count(*) AS tf FROM (SELECT doc_id, r, n, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * N_ + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM found, total GROUP BY term, N_),
scored AS (
    SELECT item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * N_) // L_))))::BIGINT AS score
    FROM found JOIN weights USING (term) JOIN asked USING (term), total GROUP BY item_id, doc_id, r)
SELECT item_id, (row_number() OVER w)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) QUALIFY rank <= 20
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_simhash": op2_simhash,
    "op3_chroma_fingerprints": op3_chroma_fingerprints,
    "op4_sharding": op4_sharding,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_html_extraction": op7_html_extraction,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_warc_audit": op10_warc_audit,
    "op11_token_counts": op11_token_counts,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE_SQL: dict[str, str] = {"op4_sharding": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op10_warc_audit": OP10_SQL, "op12_merkle_manifest": op12_sql(), "op13_ranked_search": OP13_SQL}
