"""Registered queries on records, reviews, guidelines, export, evaluation and samples, each with its oracle.

Tables and candidates come from the line items; answers, methods and logs come from events, labels,
documents, customers and parts, by arithmetic that both engines share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions import ids
from tablewright.functions.text import and_list, shortened
from tablewright.operators import evaluate, export, guidelines, review, rules, sampling
from tablewright.operators import geometry as g
from tablewright.plans.fixtures import FIXTURE_CTES, kept_by_table, slots
from tablewright.plans.table_queries import CHOICE, COMMON, PLAIN, TYPES, candidates, cells, query, selected, typed
from tablewright.sources import extract, records

FIRST = f"WITH {FIXTURE_CTES}{COMMON}"
FULL = f"{FIRST}{TYPES}"
ARTICLE = "split_part(table_uid, '/t', 1)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articled(df: DataFrame) -> DataFrame:
    return df.withColumn("pmc_id", F.split_part("table_uid", F.lit("/t"), F.lit(1)))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boundary per event, on the table that the event's number names."""
    e = F.col("event_id")
    uid = F.concat(F.lit("PMC"), (F.floor(2 * e / 20) + 1).cast("string"), F.lit("/t"), (2 * e % 20).cast("string"))
    return read(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value", uid.alias("table_uid"), (F.col("user_id") % 3).cast("int").alias("hmd"), (e % 3).cast("int").alias("vmd"))


ASKED = """, asked_ AS (SELECT event_id, event_type, user_id, value, 'PMC' || (2 * event_id // 20 + 1) || '/t' || (2 * event_id % 20) AS table_uid, (user_id % 3)::INTEGER AS hmd, (event_id % 3)::INTEGER AS vmd FROM events)"""


# --- records -----------------------------------------------------------------


@query(f"{FIRST}{ASKED} SELECT coalesce(d.table_uid, a.table_uid) AS table_uid, CASE WHEN d.table_uid IS NULL THEN 'records' ELSE 'types' END AS missing_from FROM dims d FULL JOIN (SELECT DISTINCT table_uid FROM asked_) a ON a.table_uid = d.table_uid WHERE d.table_uid IS NULL OR a.table_uid IS NULL")
def s4_unpaired(spark, sf_dir):
    return records.unpaired(slots(spark, sf_dir), asked(spark, sf_dir))


@query(f"{FIRST}{ASKED} SELECT table_uid, n_rows, n_cols FROM dims WHERE split_part(table_uid, '/t', 1) IN (SELECT split_part(table_uid, '/t', 1) FROM asked_)")
def s7_restrict(spark, sf_dir):
    shapes = articled(g.shape(slots(spark, sf_dir)))
    return records.restrict(shapes, articled(asked(spark, sf_dir))).select("table_uid", "n_rows", "n_cols")


@query(f"{FIRST}{ASKED} SELECT DISTINCT split_part(table_uid, '/t', 1) AS pmc_id FROM asked_ WHERE split_part(table_uid, '/t', 1) NOT IN (SELECT split_part(table_uid, '/t', 1) FROM dims)")
def s7_missing(spark, sf_dir):
    return records.missing(articled(asked(spark, sf_dir)), articled(slots(spark, sf_dir)))


@query(f"{FIRST}{ASKED} SELECT table_uid, CASE WHEN table_uid IN (SELECT table_uid FROM asked_) THEN 'queued' ELSE 'not_selected' END AS status FROM dims")
def s8_selected_tables(spark, sf_dir):
    return records.selected_tables(slots(spark, sf_dir).select("table_uid").distinct(), asked(spark, sf_dir))


@query(f"{FIRST}, r AS (SELECT DISTINCT table_uid, split_part(table_uid, '/t', 1) AS pmc_id FROM dims), ok AS (SELECT pmc_id FROM r GROUP BY 1 HAVING NOT bool_or(md5(table_uid) < '08')) SELECT r.table_uid, CASE WHEN ok.pmc_id IS NULL THEN 'rules' ELSE 'guided' END AS types_file FROM r LEFT JOIN ok ON ok.pmc_id = r.pmc_id")
def s9_preferred_types(spark, sf_dir):
    """Guided records lack the tables whose MD5 begins below 08, so some articles fall back."""
    ruled = articled(slots(spark, sf_dir).select("table_uid").distinct())
    return records.preferred_types(ruled.where("md5(cast(table_uid AS binary)) >= '08'"), ruled).select("table_uid", "types_file")


RESULTS = """, results AS (SELECT 'PMC' || (o_orderkey // 20 + 1) AS pmc_id, CASE WHEN o_custkey % 149 = 0 THEN 'old' ELSE 'new' END AS input_hash, CASE WHEN o_totalprice < 2000 THEN 'failed' WHEN o_orderstatus = 'P' AND o_custkey % 7 = 0 THEN 'not_selected' ELSE 'valid' END AS status, CASE WHEN o_custkey % 97 = 1 THEN 'quarantined' ELSE 'ok' END AS state FROM orders)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("PMC"), (F.floor(F.col("o_orderkey") / 20) + 1).cast("string")).alias("pmc_id"), F.when(F.col("o_custkey") % 149 == 0, "old").otherwise("new").alias("input_hash"), F.lit("m").alias("model"),
        F.when(F.col("o_totalprice") < 2000, "failed").when((F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 7 == 0), "not_selected").otherwise("valid").alias("status"), F.when(F.col("o_custkey") % 97 == 1, "quarantined").otherwise("ok").alias("state"), "o_orderkey", "o_orderpriority",
    )


@query(f"WITH x AS (SELECT 1){RESULTS} SELECT pmc_id FROM results GROUP BY 1 HAVING bool_and(input_hash = 'new' AND status NOT IN ('failed', 'not_selected'))")
def s10_reusable(spark, sf_dir):
    found = results(spark, sf_dir)
    current = found.select("pmc_id", F.lit("new").alias("current_hash"), F.lit("m").alias("current_model")).distinct()
    return records.reusable(found, current)


@query(f"WITH x AS (SELECT 1){RESULTS} SELECT pmc_id FROM results GROUP BY 1 HAVING bool_and(input_hash = 'new')")
def s11_readable_articles(spark, sf_dir):
    return records.readable_articles(results(spark, sf_dir).withColumn("schema_version", F.when(F.col("input_hash") == "new", "3.0").otherwise("1.4")))


@query(f"WITH x AS (SELECT 1){RESULTS} SELECT pmc_id, count(*) AS n_tables, count(*) FILTER (state = 'quarantined') AS n_quarantined, CASE WHEN count(*) FILTER (state = 'quarantined') = 0 THEN 'complete' WHEN count(*) FILTER (state = 'quarantined') < count(*) THEN 'partial' ELSE 'failed' END AS verdict FROM results GROUP BY 1")
def i11_article_verdicts(spark, sf_dir):
    return records.article_verdicts(results(spark, sf_dir).withColumn("status", F.col("state")))


@query("""WITH t AS (SELECT doc_id, 'See (PMC' || doc_id || '), pmc00' || (doc_id % 7) || '; PMC0 xPMC5 PMC' || doc_id || ' "PMC' || (doc_id * 1000003) || '". ' || text AS text FROM documents),
w AS (SELECT doc_id, i, upper(regexp_replace(regexp_replace(p, '^[()\\[\\]{}.!?:"''`<>]+', ''), '[()\\[\\]{}.!?:"''`<>]+$', '')) AS tok FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ ,;\\n\\r\\t]+')) AS p, generate_subscripts(regexp_split_to_array(text, '[ ,;\\n\\r\\t]+'), 1) AS i FROM t)),
n AS (SELECT doc_id, substr(tok, 4)::BIGINT AS num, min(i) AS i FROM w WHERE regexp_full_match(tok, 'PMC[0-9]{1,12}') GROUP BY ALL)
SELECT t.doc_id, coalesce(string_agg(num::VARCHAR, ',' ORDER BY i), '') AS ids FROM t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM n WHERE num > 0) n ON n.doc_id = t.doc_id AND k <= 3 GROUP BY t.doc_id""")
def i1_article_ids(spark, sf_dir):
    d = F.col("doc_id")
    text = F.concat(F.lit("See (PMC"), d, F.lit("), pmc00"), d % 7, F.lit("; PMC0 xPMC5 PMC"), d, F.lit(' "PMC'), d * 1000003, F.lit('". '), F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(ids.article_ids(text, 3), ",").alias("ids"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE 'PMC' || o_orderkey END AS name FROM orders")
def i2_article_names(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    return read(spark, sf_dir, "orders").select("o_orderkey", ids.article_name(F.when(F.col("o_orderkey") % 10 == 3, F.concat(k, F.lit("x"))).otherwise(F.concat(F.lit("000"), k))).alias("name"))


@query("SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def i3_observed_ids(spark, sf_dir):
    return records.restrict(read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")).distinct(), read(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("id")), "id")


@query("SELECT p_partkey, CASE WHEN p_size > 10 THEN 'approved' ELSE 'rejected' END AS decision, row_number() OVER (PARTITION BY p_size > 10 ORDER BY p_partkey) AS place FROM part")
def i4_approved_and_rejected(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    allowed = part.where("p_size > 10").select("p_partkey")
    both = part.select("p_partkey").join(allowed.withColumn("ok", F.lit(True)), "p_partkey", "left").select("p_partkey", F.when(F.col("ok"), "approved").otherwise("rejected").alias("decision"), F.lit(1).alias("one"))
    return evaluate.running(both, ["decision"], [F.col("p_partkey")], "one").select("p_partkey", "decision", F.col("n").alias("place"))


@query("SELECT p_partkey, p_partkey || ' | ' || coalesce(nullif(p_brand, ''), '?') || ' | ' || CASE WHEN p_size < 5 THEN '?' ELSE p_type END AS line FROM part")
def i5_summary_lines(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", ids.summary_line(F.col("p_partkey"), F.col("p_brand"), F.when(F.col("p_size") >= 5, F.col("p_type"))).alias("line"))


@query("SELECT p_partkey AS id, p_size AS n_tables FROM part WHERE p_size > 10 ORDER BY p_retailprice, p_partkey LIMIT 100")
def i6_first_with_tables(spark, sf_dir):
    ranked = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pmc_id"), F.col("p_retailprice").alias("rank"), (F.greatest(F.col("p_size"), F.lit(10)) - 10).alias("n_tables"), "p_size")
    return sampling.first_with_tables(ranked, 100).select(F.col("pmc_id").alias("id"), F.col("p_size").alias("n_tables"))


@query("WITH h AS (SELECT page_id, html, lower(substr(coalesce(html, ''), 1, 2048)) AS head FROM pages) SELECT page_id, CASE WHEN coalesce(html, '') = '' THEN 'invalid(empty_body)' WHEN page_id % 11 = 0 THEN 'ok' WHEN contains(head, 'rate limit exceeded') OR contains(head, 'too many requests') THEN 'rate_limited' WHEN contains(head, '503 service unavailable') OR contains(head, '502 bad gateway') OR contains(head, '500 internal server error') THEN 'retryable(server_unavailable)' WHEN contains(head, '<html') OR contains(head, '<!doctype html') THEN 'invalid(http_error_page)' ELSE 'invalid(malformed_or_nonarticle_xml)' END AS status FROM h")
def i7_body_status(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", ids.body_status(F.col("html"), F.col("page_id") % 11 == 0).alias("status"))


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS bytes FROM documents")
def i9_provenance(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS short FROM documents")
def r13_shortened(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", shortened(F.col("text"), 60).alias("short"))


@query("SELECT t AS n_regionkey, CASE WHEN len(l) < 2 THEN l[1] ELSE array_to_string(l[1:-2], ', ') || ' and ' || l[-1] END AS names FROM (SELECT n_regionkey AS t, list(n_name ORDER BY n_name) AS l FROM nation GROUP BY 1)")
def r13_and_lists(spark, sf_dir):
    per = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    return per.select("n_regionkey", and_list(F.col("names")).alias("names"))


# --- export ------------------------------------------------------------------


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boundary of each table by the prior, to export."""
    found = candidates(spark, sf_dir)
    return found.join(_prior(found), ["table_uid", "candidate_id"], "left_semi")


def _prior(found: DataFrame) -> DataFrame:
    from tablewright.operators.scoring import prior_choice

    return prior_choice(found).select("table_uid", F.col("selected_candidate_id").alias("candidate_id"))


PRIOR = ", best AS (SELECT table_uid, first(candidate_id ORDER BY vmd <> 1, hmd < 1, hmd, abs(hmd - 1) + abs(vmd - 1), candidate_id) AS candidate_id FROM found GROUP BY 1), pick AS MATERIALIZED (SELECT f.* FROM found f JOIN best b ON b.table_uid = f.table_uid AND b.candidate_id = f.candidate_id)"


@query(f"{FIRST}{PRIOR} SELECT s.table_uid, s.row_idx, s.col_idx, text FROM pick p JOIN slots s ON s.table_uid = p.table_uid AND row_idx >= hmd AND col_idx >= vmd JOIN cells c ON c.table_uid = s.table_uid AND c.cell_id = s.cell_id")
def e1_data_places(spark, sf_dir):
    return export.data_places(slots(spark, sf_dir), cells(spark, sf_dir), chosen(spark, sf_dir))


NODES = """, head AS (SELECT p.table_uid, cell_id, min(row_idx) AS top, min(col_idx) AS first_col, max(col_idx) AS last_col FROM pick p JOIN slots s ON s.table_uid = p.table_uid AND row_idx < hmd AND col_idx >= vmd GROUP BY ALL),
up AS (SELECT h.table_uid, h.cell_id, min(s.cell_id) AS parent_id, count(DISTINCT s.cell_id) AS n_parents FROM head h JOIN slots s ON s.table_uid = h.table_uid AND s.row_idx = top - 1 AND s.col_idx BETWEEN first_col AND last_col GROUP BY ALL)"""


@query(f"{FIRST}{PRIOR}{NODES} SELECT h.table_uid, h.cell_id, first_col, last_col, parent_id, coalesce(n_parents, 0) AS n_parents FROM head h LEFT JOIN up u ON u.table_uid = h.table_uid AND u.cell_id = h.cell_id")
def e2_header_nodes(spark, sf_dir):
    return export.header_nodes(slots(spark, sf_dir), chosen(spark, sf_dir))


@query(f"{FIRST}{PRIOR}, head AS (SELECT p.table_uid, cell_id, min(col_idx) AS top, min(row_idx) AS first_row, max(row_idx) AS last_row FROM pick p JOIN slots s ON s.table_uid = p.table_uid AND col_idx < vmd AND row_idx >= hmd GROUP BY ALL), up AS (SELECT h.table_uid, h.cell_id, min(s.cell_id) AS parent_id FROM head h JOIN slots s ON s.table_uid = h.table_uid AND s.col_idx = top - 1 AND s.row_idx BETWEEN first_row AND last_row GROUP BY ALL) SELECT h.table_uid, h.cell_id, first_row, last_row, parent_id FROM head h LEFT JOIN up u ON u.table_uid = h.table_uid AND u.cell_id = h.cell_id")
def e3_row_header_nodes(spark, sf_dir):
    turned = chosen(spark, sf_dir).select("table_uid", F.col("vmd").alias("hmd"), F.col("hmd").alias("vmd"))
    found = export.header_nodes(export.transposed(slots(spark, sf_dir)), turned)
    return found.select("table_uid", "cell_id", F.col("first_col").alias("first_row"), F.col("last_col").alias("last_row"), "parent_id")


@query(f"""{FIRST}{PRIOR}, cp AS (SELECT table_uid, col_idx, string_agg(text, ' > ' ORDER BY row_idx) AS column_path FROM (SELECT p.table_uid, s.col_idx, s.row_idx, c.text, s.cell_id, lag(s.cell_id) OVER (PARTITION BY p.table_uid, s.col_idx ORDER BY s.row_idx) AS b FROM pick p JOIN slots s ON s.table_uid = p.table_uid AND s.row_idx < hmd AND s.col_idx >= vmd JOIN cells c ON c.table_uid = s.table_uid AND c.cell_id = s.cell_id) WHERE b IS DISTINCT FROM cell_id GROUP BY ALL),
rp AS (SELECT table_uid, row_idx, string_agg(text, ' > ' ORDER BY col_idx) AS row_path FROM (SELECT p.table_uid, s.col_idx, s.row_idx, c.text, s.cell_id, lag(s.cell_id) OVER (PARTITION BY p.table_uid, s.row_idx ORDER BY s.col_idx) AS b FROM pick p JOIN slots s ON s.table_uid = p.table_uid AND s.col_idx < vmd AND s.row_idx >= hmd JOIN cells c ON c.table_uid = s.table_uid AND c.cell_id = s.cell_id) WHERE b IS DISTINCT FROM cell_id GROUP BY ALL)
SELECT s.table_uid, s.row_idx, s.col_idx, text, column_path, row_path FROM pick p JOIN slots s ON s.table_uid = p.table_uid AND s.row_idx >= hmd AND s.col_idx >= vmd JOIN cells c ON c.table_uid = s.table_uid AND c.cell_id = s.cell_id
LEFT JOIN cp ON cp.table_uid = s.table_uid AND cp.col_idx = s.col_idx LEFT JOIN rp ON rp.table_uid = s.table_uid AND rp.row_idx = s.row_idx""")
def e7_relational(spark, sf_dir):
    return export.relational(slots(spark, sf_dir), cells(spark, sf_dir), chosen(spark, sf_dir))


# --- review ------------------------------------------------------------------


@query(f"{FIRST}{PRIOR}{ASKED}, k AS (SELECT table_uid, split_part(table_uid, '/t', 2)::INTEGER AS k FROM dims), chars AS (SELECT table_uid, sum(length(text)) AS n_chars FROM cells GROUP BY 1) SELECT d.table_uid, CASE WHEN d.table_uid NOT IN (SELECT table_uid FROM asked_) THEN 'not_selected' WHEN k = 6 THEN 'quarantined' WHEN b.candidate_id IS NULL THEN 'parser_abstained' WHEN k = 8 THEN 'no_selected_candidate' WHEN n_rows * n_cols > 2500 OR n_chars > 60000 THEN 'too_large' ELSE 'ask' END AS decision FROM dims d JOIN k ON k.table_uid = d.table_uid JOIN chars c ON c.table_uid = d.table_uid LEFT JOIN best b ON b.table_uid = d.table_uid")
def r2_queue(spark, sf_dir):
    """Every table 6 of an article counts as quarantined, every table 8 as one without a selected candidate."""
    all_, found = slots(spark, sf_dir), candidates(spark, sf_dir)
    n = found.groupBy("table_uid").agg(F.count("*").alias("n_candidates"))
    queued = records.selected_tables(all_.select("table_uid").distinct(), asked(spark, sf_dir)).select("table_uid", (F.col("status") == "queued").alias("selected"))
    chars = cells(spark, sf_dir).groupBy("table_uid").agg(F.sum(F.length("text")).alias("n_chars"))
    k = F.split_part("table_uid", F.lit("/t"), F.lit(2)).cast("int")
    chosen_ = _prior(found).select("table_uid", F.when(k != 8, F.col("candidate_id")).alias("selected_candidate_id"))
    tables = g.shape(all_).join(n, "table_uid", "left").fillna(0, ["n_candidates"]).join(queued, "table_uid").join(chars, "table_uid").join(chosen_, "table_uid", "left")
    return review.queue(tables.withColumn("quarantined", k == 6))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).withColumn("tag", F.when(F.col("row_idx") == 0, "th").otherwise("td"))


LINES_SQL = """, parts AS (SELECT s.table_uid, s.row_idx, s.col_idx, 'c' || s.col_idx || CASE WHEN s.row_idx = 0 AND c.row_idx = 0 AND s.col_idx = c.col_idx THEN '* ' ELSE ' ' END || CASE WHEN s.row_idx = c.row_idx AND s.col_idx = c.col_idx THEN '"' || replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '"', '\\"') || '"' WHEN s.row_idx > c.row_idx AND s.col_idx > c.col_idx THEN '^<' WHEN s.row_idx > c.row_idx THEN '^' ELSE '<' END AS part
FROM slots s JOIN cells c ON c.table_uid = s.table_uid AND c.cell_id = s.cell_id), rows_ AS (SELECT table_uid, row_idx, 'row ' || row_idx || ': ' || string_agg(part, ' | ' ORDER BY col_idx) AS line FROM parts GROUP BY table_uid, row_idx)"""


@query(f"{FIRST}{LINES_SQL} SELECT table_uid, row_idx, line FROM rows_")
def r3_table_lines(spark, sf_dir):
    """Cells of a table's first row count as th."""
    return review.table_lines(slots(spark, sf_dir), tagged(spark, sf_dir))


@query(f"""{FIRST}{LINES_SQL}, told AS (SELECT table_uid, CASE WHEN k % 4 = 0 THEN '' ELSE 'Label: Table ' || k || chr(10) END || CASE k % 3 WHEN 0 THEN 'Caption: ' || repeat('long ', 300) || ' [...]' || chr(10) ELSE '' END || CASE WHEN k % 2 = 1 THEN 'Notes: a b ' || k || chr(10) ELSE '' END AS told FROM (SELECT table_uid, split_part(table_uid, '/t', 2)::INTEGER AS k FROM dims))
SELECT r.table_uid, any_value(told) || 'BEGIN TABLE (' || any_value(n_rows) || ' rows x ' || any_value(n_cols) || ' columns)' || chr(10) || string_agg(line, chr(10) ORDER BY row_idx) || chr(10) || 'END TABLE' AS block FROM rows_ r JOIN dims d ON d.table_uid = r.table_uid JOIN told t ON t.table_uid = r.table_uid GROUP BY r.table_uid""")
def r3_table_blocks(spark, sf_dir):
    """With labels on three tables of four, a caption beyond the limit on each third, and notes on each second."""
    all_ = slots(spark, sf_dir)
    k = F.split_part("table_uid", F.lit("/t"), F.lit(2)).cast("int")
    notes = F.when(k % 2 == 1, F.array(F.lit("a"), F.lit(" b"), k.cast("string")))
    context = all_.select("table_uid").distinct().select("table_uid", F.when(k % 4 != 0, F.concat(F.lit(" Table  "), k.cast("string"))).alias("label"), F.when(k % 3 == 0, F.repeat(F.lit("long "), 400)).otherwise(" ").alias("caption"), notes.alias("notes"))
    return review.table_blocks(review.table_lines(all_, tagged(spark, sf_dir)), g.shape(all_), context)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's answer as JSON: truth values and their texts, counts as whole numbers, as their text, with a
    zero fraction, and, which is no integer's text, as the text of that."""
    e = asked(spark, sf_dir)
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    plain = lambda c: F.col(c).cast("string")
    whole = lambda c: F.concat(plain(c), F.lit(".0"))
    count = lambda c: F.when(F.col("event_id") % 10 == 0, quoted(whole(c))).when(F.col("user_id") % 4 == 0, quoted(plain(c))).when(F.col("user_id") % 4 == 1, whole(c)).otherwise(plain(c))
    right = F.when(F.col("event_type") == "view", F.when(F.col("user_id") % 2 == 0, "true").otherwise('"true"')).when(F.col("event_type") == "click", '"false"').when(F.col("event_type") == "error", '"TRUE"').otherwise("false")
    return e.withColumn("answer", F.concat(F.lit('{"parse_correct": '), right, F.lit(', "column_header_rows": '), count("hmd"), F.lit(', "row_header_columns": '), count("vmd"), F.lit(', "reason": "r"}')))


def read_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = review.answer_fields(F.col("answer"), F.lit(50), F.lit(7))
    return answers(spark, sf_dir).select("event_id", "table_uid", *[c.alias(n) for n, c in fields.items()])


READ = """, read_ AS (SELECT event_id, table_uid, verdict, CASE verdict WHEN 'counts' THEN hmd END AS hmd, CASE verdict WHEN 'counts' THEN vmd END AS vmd
    FROM (SELECT *, CASE WHEN event_type = 'view' THEN 'confirmed' WHEN event_type = 'error' OR event_id % 10 = 0 THEN 'retry' ELSE 'counts' END AS verdict FROM asked_))"""


@query(f"WITH x AS (SELECT 1){ASKED}{READ} SELECT event_id, verdict, hmd, vmd FROM read_")
def r5_read_answers(spark, sf_dir):
    return read_answers(spark, sf_dir).select("event_id", "verdict", "hmd", "vmd")


DECIDED = f"{PRIOR}{ASKED}{READ}, decided AS (SELECT a.event_id, a.table_uid, CASE WHEN verdict = 'retry' THEN 'unreviewed' WHEN verdict = 'confirmed' AND b.candidate_id IS NOT NULL THEN 'valid' WHEN verdict = 'counts' AND f.candidate_id IS NOT NULL THEN 'valid' ELSE 'unparseable' END AS final_status, CASE verdict WHEN 'confirmed' THEN b.candidate_id WHEN 'counts' THEN f.candidate_id END AS candidate_id FROM read_ a LEFT JOIN best b ON b.table_uid = a.table_uid LEFT JOIN found f ON f.table_uid = a.table_uid AND f.hmd = a.hmd AND f.vmd = a.vmd)"


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = candidates(spark, sf_dir)
    return review.decide(read_answers(spark, sf_dir), found, _prior(found).withColumnRenamed("candidate_id", "selected_candidate_id"))


@query(f"{FIRST}{DECIDED} SELECT table_uid, final_status, candidate_id FROM decided")
def r6_decisions(spark, sf_dir):
    return decisions(spark, sf_dir)


@query(f"{FIRST}{DECIDED} SELECT split_part(table_uid, '/t', 1) AS pmc_id, final_status, count(*) AS n FROM decided GROUP BY ALL")
def r8_status_counts(spark, sf_dir):
    return review.status_counts(articled(decisions(spark, sf_dir)))


@query(f"{FIRST}{ASKED}, t AS (SELECT DISTINCT table_uid, hmd, vmd FROM asked_) SELECT * FROM (SELECT t.table_uid, t.hmd AS at_hmd, t.vmd AS at_vmd, candidate_id, abs(f.hmd - t.hmd) + abs(f.vmd - t.vmd) AS steps, (row_number() OVER (PARTITION BY t.table_uid, t.hmd, t.vmd ORDER BY abs(f.hmd - t.hmd) + abs(f.vmd - t.vmd), f.hmd, f.vmd))::INTEGER AS place FROM t JOIN found f ON f.table_uid = t.table_uid) WHERE place <= 3")
def r14_nearest(spark, sf_dir):
    return review.nearest(asked(spark, sf_dir).select("table_uid", "hmd", "vmd").distinct(), candidates(spark, sf_dir))


@query(f"{FIRST}, r AS (SELECT table_uid, n_rows, n_cols, 0 AS a, (n_rows // 2)::INTEGER AS b FROM dims UNION ALL SELECT table_uid, n_rows, n_cols, (n_rows // 2)::INTEGER, n_rows - 2 FROM dims WHERE n_rows - 2 >= n_rows // 2), p AS (SELECT r.table_uid, x.x, count(*) AS k FROM r, range(0, 100) x(x) WHERE x BETWEEN a AND b GROUP BY ALL), s AS (SELECT p.table_uid, count(*) FILTER (k = 1) * 7 AS once, count(*) FILTER (k > 1) * 7 AS overlapping FROM p GROUP BY 1) SELECT s.table_uid, once, overlapping, n_rows * n_cols - once - overlapping AS uncovered FROM s JOIN dims d ON d.table_uid = s.table_uid")
def r10_segmentation_checks(spark, sf_dir):
    """Two halves of a table that share the middle row, without the last one."""
    shapes = g.shape(slots(spark, sf_dir))
    half = F.floor(F.col("n_rows") / 2).cast("int")
    rectangle = lambda first, last: F.struct(first.alias("first_row"), last.alias("last_row"), F.lit(0).alias("first_col"), (F.col("n_cols") - 1).alias("last_col"))
    one, two = rectangle(F.lit(0), half), rectangle(half, F.col("n_rows") - 2)
    both = shapes.select("table_uid", F.inline(F.when(F.col("n_rows") - 2 >= half, F.array(one, two)).otherwise(F.array(one))))
    return review.segmentation_checks(both, shapes)


# --- guidelines --------------------------------------------------------------

#: What the oracle routes: texts of columns typed by the rules, with the guideline types below each.
ALLOWED = "CASE type " + " ".join(f"WHEN '{k}' THEN '{'|'.join(t for _, t in rules.SCIENCE.guidelines if k in rules.SCIENCE.above(t))}'" for k in rules.SCIENCE.types() if any(k in rules.SCIENCE.above(t) for _, t in rules.SCIENCE.guidelines)) + " END"
LOG = ", log AS (SELECT event_id AS seq, CASE user_id % 4 WHEN 0 THEN 'Flag' WHEN 1 THEN 'Status' WHEN 2 THEN 'Ship date' ELSE 'A' END AS text, CASE user_id % 4 WHEN 2 THEN 'Phrase' ELSE 'Word' END AS rule_type, CASE event_type WHEN 'view' THEN 'VariableLabel' WHEN 'click' THEN 'CategoryLevel' WHEN 'error' THEN 'Other' ELSE 'none' END AS answer FROM events)"
ROUTED = f", routed AS (SELECT table_uid, split_part(table_uid, '/t', 1) AS pmc_id, cell_id, text, type, {ALLOWED} AS allowed FROM types WHERE {ALLOWED} IS NOT NULL)"


def answer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id") % 4
    text = F.when(u == 0, "Flag").when(u == 1, "Status").when(u == 2, "Ship date").otherwise("A")
    answer = F.when(F.col("event_type") == "view", "VariableLabel").when(F.col("event_type") == "click", "CategoryLevel").when(F.col("event_type") == "error", "Other").otherwise("none")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), text.alias("text"), F.when(u == 2, "Phrase").otherwise("Word").alias("rule_type"), answer.alias("answer"))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guidelines.routes(rules.SCIENCE, articled(typed(spark, sf_dir, text=True)))


@query(f"{FULL}{ROUTED} SELECT table_uid, cell_id, type, allowed FROM routed")
def l1_routes(spark, sf_dir):
    return routed(spark, sf_dir).select("table_uid", "cell_id", "type", "allowed")


ASKS = f"{ROUTED}{LOG}, reqs AS (SELECT DISTINCT pmc_id, text, type AS rule_type, allowed FROM routed r WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.text = r.text AND l.rule_type = r.type))"


@query(f"{FULL}{ASKS} SELECT pmc_id, text, rule_type, allowed FROM reqs")
def l2_requests(spark, sf_dir):
    return guidelines.requests(routed(spark, sf_dir), answer_log(spark, sf_dir))


@query(f"{FULL}{ASKS} SELECT pmc_id, text, rule_type, allowed, pmc_id || '/' || ((row_number() OVER w - 1) // 40 + 1) AS batch_id, ((row_number() OVER w - 1) % 40 + 1)::INTEGER AS item FROM reqs WINDOW w AS (PARTITION BY pmc_id ORDER BY text, rule_type)")
def l3_batches(spark, sf_dir):
    return guidelines.batches(guidelines.requests(routed(spark, sf_dir), answer_log(spark, sf_dir)))


@query(f"WITH x AS (SELECT 1){LOG} SELECT text, rule_type, arg_max(answer, seq) AS answer FROM log GROUP BY ALL")
def l6_latest_answers(spark, sf_dir):
    return guidelines.latest(answer_log(spark, sf_dir))


APPLIED = f"{ROUTED}{LOG}, last_ AS (SELECT text, rule_type, arg_max(answer, seq) AS answer FROM log GROUP BY ALL), applied AS (SELECT r.table_uid, r.cell_id, CASE WHEN list_contains(string_split(allowed, '|'), answer) THEN 'guided' WHEN answer = 'none' THEN 'kept' ELSE 'pending' END AS derivation, CASE WHEN list_contains(string_split(allowed, '|'), answer) THEN answer ELSE type END AS guided_type FROM routed r LEFT JOIN last_ l ON l.text = r.text AND l.rule_type = r.type)"


def applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guidelines.apply(routed(spark, sf_dir), guidelines.latest(answer_log(spark, sf_dir)))


@query(f"{FULL}{APPLIED} SELECT table_uid, cell_id, derivation, guided_type FROM applied")
def l7_apply_answers(spark, sf_dir):
    return applied(spark, sf_dir).select("table_uid", "cell_id", "derivation", "guided_type")


@query(f"{FULL}{APPLIED} SELECT derivation, guided_type, count(*) AS n FROM applied GROUP BY ALL")
def l8_derivations(spark, sf_dir):
    return applied(spark, sf_dir).groupBy("derivation", "guided_type").agg(F.count("*").alias("n"))


# --- evaluation --------------------------------------------------------------

INFO = f"{PRIOR}, xy AS MATERIALIZED (SELECT t.table_uid, t.cell_id, family AS x, CASE WHEN c.row_idx < hmd THEN 'hmd' WHEN c.col_idx < vmd THEN 'vmd' ELSE 'data' END AS y FROM types t JOIN cells c ON c.table_uid = t.table_uid AND c.cell_id = t.cell_id JOIN pick p ON p.table_uid = t.table_uid)"


def region_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = g.labels(chosen(spark, sf_dir), cells(spark, sf_dir))
    return regions.join(typed(spark, sf_dir), ["table_uid", "cell_id"]).select("table_uid", F.col("family").alias("x"), F.col("region").alias("y"))


@query(f"{FULL}{INFO}, c AS (SELECT x, y, count(*) AS c, sum(count(*)) OVER (PARTITION BY x) AS cx, sum(count(*)) OVER (PARTITION BY y) AS cy, sum(count(*)) OVER () AS n FROM xy GROUP BY x, y) SELECT round(sum(c / n * log2(c * n / (cx * cy))), 6) AS mi, round(sum(-c / n * log2(cy / n)), 6) AS entropy FROM c")
def a1_mutual_information(spark, sf_dir):
    return evaluate.mutual_information(region_pairs(spark, sf_dir)).select(F.round("mi", 6).alias("mi"), F.round("entropy", 6).alias("entropy"))


@query(f"{FULL}{INFO}, c AS (SELECT table_uid, x, y, count(*) AS c, sum(count(*)) OVER (PARTITION BY table_uid, x) AS cx, sum(count(*)) OVER (PARTITION BY table_uid, y) AS cy, sum(count(*)) OVER (PARTITION BY table_uid) AS n FROM xy GROUP BY table_uid, x, y), t AS (SELECT table_uid, sum(c / n * log2(c * n / (cx * cy))) AS mi, sum(-c / n * log2(cy / n)) AS e FROM c GROUP BY 1) SELECT round(avg(mi), 6) AS mi, round(avg(mi) / avg(e), 6) AS share FROM t")
def a2_macro_information(spark, sf_dir):
    return evaluate.macro_information(evaluate.mutual_information(region_pairs(spark, sf_dir), ["table_uid"])).select(F.round("mi", 6).alias("mi"), F.round("share", 6).alias("share"))


@query(f"{FULL}{INFO} SELECT x, y, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY y), 6) AS share FROM xy GROUP BY x, y")
def a4_share_given_region(spark, sf_dir):
    return evaluate.share_given(region_pairs(spark, sf_dir)).withColumn("share", F.round("share", 6))


IGNORED = "('empty', 'untyped', 'Missing')"


def contrast_sql(axis: str, line: str, along: str, head: str) -> str:
    return f"""(SELECT m.table_uid, '{axis}' AS axis, count(*) FILTER (mode <> heading) AS differing, count(*) AS n_lines
    FROM (SELECT table_uid, line, first(x ORDER BY k DESC, seen) AS mode FROM (SELECT table_uid, line, x, count(*) AS k, min(seen) AS seen FROM (SELECT table_uid, {line} AS line, cell_id, x, min({along}) AS seen FROM at_ WHERE y = 'data' AND x NOT IN {IGNORED} GROUP BY ALL) GROUP BY ALL) GROUP BY ALL) m
    JOIN (SELECT table_uid, {line} AS line, arg_max(x, {along}) AS heading FROM at_ WHERE y = '{head}' GROUP BY ALL) h ON h.table_uid = m.table_uid AND h.line = m.line
    WHERE heading NOT IN {IGNORED} GROUP BY m.table_uid)"""


CONTRAST = f"{INFO}, at_ AS MATERIALIZED (SELECT s.table_uid, s.row_idx, s.col_idx, s.cell_id, x, y FROM slots s JOIN xy ON xy.table_uid = s.table_uid AND xy.cell_id = s.cell_id), contrasts AS ({contrast_sql('col', 'col_idx', 'row_idx', 'hmd')} UNION ALL {contrast_sql('row', 'row_idx', 'col_idx', 'vmd')})"


def contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.line_contrast(slots(spark, sf_dir), g.labels(chosen(spark, sf_dir), cells(spark, sf_dir)), typed(spark, sf_dir))


@query(f"{FULL}{CONTRAST} SELECT table_uid, axis, differing, n_lines FROM contrasts")
def a7_contrast(spark, sf_dir):
    return contrasts(spark, sf_dir)


@query(f"{FULL}{CONTRAST} SELECT axis, sum(n_lines)::BIGINT AS n_lines, round(sum(differing) / sum(n_lines), 6) AS share FROM contrasts GROUP BY 1")
def a7_contrast_summary(spark, sf_dir):
    return evaluate.contrast_summary(contrasts(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query(f"{FULL}{INFO} SELECT table_uid, CASE WHEN count(*) FILTER (x = 'Numeric') * 2 > count(*) FILTER (x NOT IN {IGNORED}) THEN 'mostly_numeric' WHEN count(*) FILTER (x = 'Text') * 2 > count(*) FILTER (x NOT IN {IGNORED}) THEN 'mostly_text' ELSE 'mixed' END AS kind FROM xy WHERE y = 'data' GROUP BY 1")
def a9_data_kinds(spark, sf_dir):
    return evaluate.data_kinds(region_pairs(spark, sf_dir).select("table_uid", F.col("y").alias("region"), F.col("x").alias("family")))


GOLD = ", gold AS (SELECT table_uid, CASE WHEN k % 5 = 0 THEN NULL ELSE 1 + (k % 3 = 0)::INTEGER END AS hmd, CASE WHEN k % 5 = 0 THEN NULL ELSE (k % 2)::INTEGER END AS vmd FROM (SELECT table_uid, split_part(table_uid, '/t', 2)::INTEGER AS k FROM dims))"


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.split_part("table_uid", F.lit("/t"), F.lit(2)).cast("int")
    tables = slots(spark, sf_dir).select("table_uid").distinct()
    return tables.select("table_uid", F.when(k % 5 != 0, 1 + (k % 3 == 0).cast("int")).alias("hmd"), F.when(k % 5 != 0, (k % 2).cast("int")).alias("vmd"))


@query(f"""{FIRST}{GOLD}, per AS (SELECT g.table_uid, g.hmd IS NOT NULL AS real_, split_part(g.table_uid, '/t', 2) = '11' AS q, count(f.candidate_id) AS n, coalesce(bool_or(f.hmd = g.hmd AND f.vmd = g.vmd), false) AS hit FROM gold g LEFT JOIN found f ON f.table_uid = g.table_uid GROUP BY g.table_uid, g.hmd)
SELECT round(count(*) FILTER (real_ AND hit) / count(*) FILTER (real_), 6) AS candidate_recall, round(count(*) FILTER (n = 1 AND real_ AND hit) / nullif(count(*) FILTER (n = 1 AND NOT q), 0), 6) AS unique_precision, round(count(*) FILTER (n = 1 AND NOT q) / count(*), 6) AS unique_coverage, round(count(*) FILTER (n = 1 AND real_ AND hit) / count(*), 6) AS exact_match,
round(count(*) FILTER (NOT real_ AND n > 0) / count(*) FILTER (NOT real_), 6) AS false_rate, round(count(*) FILTER (n = 0 AND NOT q) / count(*), 6) AS abstention, round(count(*) FILTER (n > 1 AND NOT q) / count(*), 6) AS ambiguity FROM per""")
def a11_structural_metrics(spark, sf_dir):
    """Every table 11 of an article counts as quarantined."""
    all_ = slots(spark, sf_dir)
    tables = all_.select("table_uid").distinct().withColumn("status", F.when(F.split_part("table_uid", F.lit("/t"), F.lit(2)) == "11", "quarantined").otherwise("ok"))
    found = evaluate.structural_metrics(tables, g.boundaries(all_), gold(spark, sf_dir))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query(f"{FIRST}{GOLD} SELECT d.table_uid, 'h' || hmd || '_v' || vmd AS gold_candidate, confidence FROM dims d JOIN (SELECT *, (split_part(table_uid, '/t', 2)::INTEGER % 4)::INTEGER AS confidence FROM gold) g ON g.table_uid = d.table_uid WHERE confidence >= 2 AND hmd IS NOT NULL")
def a10_labelled_set(spark, sf_dir):
    k = F.split_part("table_uid", F.lit("/t"), F.lit(2)).cast("int")
    named = gold(spark, sf_dir).select("table_uid", F.concat(F.lit("h"), F.col("hmd").cast("string"), F.lit("_v"), F.col("vmd").cast("string")).alias("gold_candidate"), (k % 4).alias("confidence"))
    return evaluate.labelled_set(slots(spark, sf_dir).select("table_uid").distinct(), named, 2)


@query(f"{FULL} SELECT count(*) AS n, round(avg((type = 'Word')::INTEGER), 6) AS type_agreement, round(avg((grp = 'Text')::INTEGER), 6) AS group_agreement FROM types WHERE cell_id % 3 = 0 AND split_part(table_uid, '/t', 1) NOT IN ('PMC1', 'PMC2')")
def a25_agreement(spark, sf_dir):
    """Every third cell labelled as a word, two articles left out."""
    given = typed(spark, sf_dir)
    labelled = given.where("cell_id % 3 = 0").select("table_uid", "cell_id", F.lit("Word").alias("wanted_type"), F.lit("Text").alias("wanted_group"))
    found = evaluate.agreement(given, labelled, ["PMC1", "PMC2"])
    return found.select("n", F.round("type_agreement", 6).alias("type_agreement"), F.round("group_agreement", 6).alias("group_agreement"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def a12_duplicate_keys(spark, sf_dir):
    return evaluate.duplicate_keys(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


METHODS = ", methods AS (SELECT 'prior' AS method, d.table_uid, b.candidate_id AS chosen, 'h' || g.hmd || '_v' || g.vmd AS gold_id FROM dims d JOIN gold g ON g.table_uid = d.table_uid AND g.hmd IS NOT NULL LEFT JOIN best b ON b.table_uid = d.table_uid UNION ALL SELECT 'one_one', d.table_uid, 'h1_v1', 'h' || g.hmd || '_v' || g.vmd FROM dims d JOIN gold g ON g.table_uid = d.table_uid AND g.hmd IS NOT NULL)"


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = gold(spark, sf_dir).where("hmd IS NOT NULL").select("table_uid", F.concat(F.lit("h"), F.col("hmd").cast("string"), F.lit("_v"), F.col("vmd").cast("string")).alias("gold"))
    prior = labelled.join(_prior(candidates(spark, sf_dir)), "table_uid", "left").select(F.lit("prior").alias("method"), "table_uid", F.col("candidate_id").alias("chosen"), "gold")
    return prior.unionByName(labelled.select(F.lit("one_one").alias("method"), "table_uid", F.lit("h1_v1").alias("chosen"), "gold"))


@query(f"{FIRST}{PRIOR}{GOLD}{METHODS} SELECT method, count(chosen) AS decided, count(*) FILTER (chosen = gold_id) AS correct, round(count(chosen) / count(DISTINCT table_uid), 6) AS coverage, round(count(*) FILTER (chosen = gold_id) / count(chosen), 6) AS accuracy FROM methods GROUP BY 1")
def a13_method_accuracy(spark, sf_dir):
    return evaluate.method_accuracy(methods(spark, sf_dir)).withColumn("coverage", F.round("coverage", 6)).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT event_type AS method, event_id::VARCHAR AS table_uid, count(*) OVER w AS n, round(avg((user_id % 3 = 0)::INTEGER) OVER w, 6) AS accuracy FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value DESC, event_id::VARCHAR ROWS UNBOUNDED PRECEDING)")
def a14_risk_coverage(spark, sf_dir):
    log = read(spark, sf_dir, "events").select(F.col("event_type").alias("method"), F.col("event_id").cast("string").alias("table_uid"), F.col("value").alias("margin"), (F.col("user_id") % 3 == 0).cast("int").alias("correct"))
    return evaluate.risk_coverage(log).withColumn("accuracy", F.round("accuracy", 6))


OUTCOME = "CASE WHEN event_id % 13 = 0 THEN 'not_reviewed' WHEN value <= 5 THEN 'rejected' WHEN event_id % 11 = 0 THEN 'invalid_output' WHEN user_id % 2 = 0 THEN 'correct' ELSE 'wrong_accepted' END"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 13 == 0, "unreviewed").when(F.col("value") <= 5, "unparseable").otherwise("valid")
    return e.withColumn("outcome", evaluate.outcome_class(status, F.when(F.col("event_id") % 11 == 0, "unknown_candidate"), F.col("user_id") % 2 == 0))


@query(f"SELECT event_id, {OUTCOME} AS outcome FROM events")
def a16_outcomes(spark, sf_dir):
    return outcomes(spark, sf_dir).select("event_id", "outcome")


LABELLED = """, before_ AS (SELECT d.table_uid, r.row_idx, count(a.row_idx) FILTER (a.row_idx < r.row_idx AND a.row_idx >= 1) AS n_aside, coalesce(bool_or(a.row_idx = r.row_idx), false) AS is_aside FROM dims d JOIN (SELECT DISTINCT table_uid, row_idx FROM slots) r ON r.table_uid = d.table_uid LEFT JOIN aside a ON a.table_uid = r.table_uid GROUP BY ALL),
answered AS (SELECT s.table_uid, s.row_idx, col_idx, CASE WHEN is_aside THEN 'separator' WHEN s.row_idx < 1 THEN 'uncovered' WHEN s.row_idx - 1 - n_aside < 1 THEN 'hmd' WHEN col_idx < 1 THEN 'vmd' ELSE 'data' END AS region FROM slots s JOIN before_ b ON b.table_uid = s.table_uid AND b.row_idx = s.row_idx)"""


def answered_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segmentation of each table: all but its first row as one rectangle with a header row and a header column,
    rows of one cell set aside."""
    all_ = slots(spark, sf_dir)
    rectangle = g.shape(all_).select("table_uid", F.lit(1).alias("first_row"), (F.col("n_rows") - 1).alias("last_row"), F.lit(0).alias("first_col"), (F.col("n_cols") - 1).alias("last_col"), F.lit(1).alias("head_rows"), F.lit(1).alias("side_cols"))
    return evaluate.place_labels(all_, rectangle, g.separators(all_))


@query(f"{FIRST}{LABELLED} SELECT table_uid, row_idx, col_idx, region FROM answered")
def a17_place_labels(spark, sf_dir):
    return answered_places(spark, sf_dir)


@query(f"{FIRST}{PRIOR}{LABELLED} SELECT c.table_uid, round(avg((region = CASE WHEN c.row_idx < hmd THEN 'hmd' WHEN c.col_idx < vmd THEN 'vmd' WHEN hmd IS NOT NULL THEN 'data' END)::INTEGER), 6) AS accuracy FROM cells c JOIN answered a ON a.table_uid = c.table_uid AND a.row_idx = c.row_idx AND a.col_idx = c.col_idx LEFT JOIN pick p ON p.table_uid = c.table_uid GROUP BY 1")
def a18_cell_accuracy(spark, sf_dir, exact=False):
    """Against the prior's boundary; null for a table without a candidate."""
    all_ = slots(spark, sf_dir)
    size = g.shape(all_).select("table_uid", "n_rows", "n_cols")
    whole = chosen(spark, sf_dir).join(size, "table_uid").select("table_uid", F.lit(0).alias("first_row"), (F.col("n_rows") - 1).alias("last_row"), F.lit(0).alias("first_col"), (F.col("n_cols") - 1).alias("last_col"), F.col("hmd").alias("head_rows"), F.col("vmd").alias("side_cols"))
    truth = kept_by_table(evaluate.place_labels(all_, whole, g.separators(all_).limit(0)))
    found = evaluate.cell_accuracy(cells(spark, sf_dir), kept_by_table(answered_places(spark, sf_dir)), truth)
    return found if exact else found.withColumn("accuracy", F.round("accuracy", 6))


@query(f"""{FIRST}{PRIOR}{LABELLED}, acc AS (SELECT c.table_uid, avg((region = CASE WHEN c.row_idx < hmd THEN 'hmd' WHEN c.col_idx < vmd THEN 'vmd' WHEN hmd IS NOT NULL THEN 'data' END)::INTEGER) AS accuracy FROM cells c JOIN answered a ON a.table_uid = c.table_uid AND a.row_idx = c.row_idx AND a.col_idx = c.col_idx LEFT JOIN pick p ON p.table_uid = c.table_uid GROUP BY 1),
arms AS (SELECT arm, d.table_uid FROM dims d, (VALUES ('all'), ('some')) v(arm))
SELECT arm, count(accuracy) AS n_answered, round(avg(accuracy), 6) AS answered, round(avg(coalesce(accuracy, 0)), 6) AS end_to_end FROM arms LEFT JOIN acc ON acc.table_uid = arms.table_uid AND (arm = 'all' OR split_part(acc.table_uid, '/t', 2)::INTEGER % 3 > 0) GROUP BY 1""")
def a18_end_to_end(spark, sf_dir):
    """Two arms with the same answers, one without those of every third table."""
    per = a18_cell_accuracy(spark, sf_dir, exact=True)
    left = F.split_part("table_uid", F.lit("/t"), F.lit(2)).cast("int") % 3 > 0
    both = per.withColumn("arm", F.explode(F.when(left, F.array(F.lit("all"), F.lit("some"))).otherwise(F.array(F.lit("all")))))
    tables = slots(spark, sf_dir).select("table_uid").distinct().select("table_uid", F.explode(F.array(F.lit("all"), F.lit("some"))).alias("arm"))
    return evaluate.end_to_end(both, tables).select("arm", "n_answered", F.round("answered", 6).alias("answered"), F.round("end_to_end", 6).alias("end_to_end"))


@query("SELECT event_type AS arm, count(*) AS calls, sum((event_id % 1000)::BIGINT)::BIGINT AS tokens, round(sum((event_id % 1000) * CASE user_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 ELSE 0 END)::DOUBLE, 4) AS cost FROM events GROUP BY 1")
def a19_usage(spark, sf_dir):
    log = read(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), (F.col("user_id") % 3).alias("model"), (F.col("event_id") % 1000).alias("tokens"))
    prices = spark.sql("SELECT * FROM VALUES (0L, 0.5D), (1L, 0.25D) AS v(model, price)")
    return evaluate.usage(log, prices).withColumn("cost", F.round("cost", 4))


@query(f"SELECT event_type AS arm, user_id % 4 AS part, count(*) AS n, count(*) FILTER ({OUTCOME} = 'correct') AS correct FROM events GROUP BY ROLLUP (event_type, user_id % 4)")
def a20_summary(spark, sf_dir):
    return evaluate.summary(outcomes(spark, sf_dir).select(F.col("event_type").alias("arm"), (F.col("user_id") % 4).alias("part"), "outcome"), "arm", "part", "outcome")


@query(f"{FIRST}{PRIOR}{GOLD}{METHODS}, ab AS (SELECT table_uid, bool_or(method = 'prior' AND coalesce(chosen = gold_id, false)) AS a, bool_or(method = 'one_one' AND chosen = gold_id) AS b FROM methods GROUP BY 1) SELECT count(*) FILTER (a AND NOT b) AS only_first, count(*) FILTER (b AND NOT a) AS only_second, count(*) FILTER (a AND b) AS both, count(*) FILTER (NOT a AND NOT b) AS neither, round((SELECT least(1, 2 * sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)))) FROM (SELECT count(*) FILTER (a <> b) AS n, least(count(*) FILTER (a AND NOT b), count(*) FILTER (b AND NOT a)) AS m FROM ab) x, range(0, 1000000) r(k) WHERE k <= m), 6) AS p FROM ab")
def a22_paired(spark, sf_dir):
    counts = evaluate.paired(methods(spark, sf_dir).select("method", "table_uid", F.coalesce(F.col("chosen") == F.col("gold"), F.lit(False)).alias("correct")), "prior", "one_one")
    return evaluate.paired_probability(counts).withColumn("p", F.round("p", 6))


@query("SELECT slice, count(*) AS n, count(*) FILTER (toxic = 1) AS disagreeing, round(avg(toxic), 6) AS rate FROM (SELECT toxic, unnest(CASE WHEN quality = 1 THEN ['all', 'good'] ELSE ['all'] END || CASE WHEN doc_id % 2 = 0 THEN ['even'] ELSE [] END) AS slice FROM labels) GROUP BY 1")
def a23_slice_rates(spark, sf_dir):
    slices = F.array_compact(F.array(F.lit("all"), F.when(F.col("quality") == 1, "good"), F.when(F.col("doc_id") % 2 == 0, "even")))
    labels = read(spark, sf_dir, "labels").withColumn("disagrees", F.col("toxic") == 1)
    return evaluate.slice_rates(labels, slices).withColumn("rate", F.round("rate", 6))


@query("SELECT count(DISTINCT event_type) AS event_type, count(DISTINCT user_id) AS user_id FROM events")
def a24_provenance(spark, sf_dir):
    return evaluate.mixed_provenance(read(spark, sf_dir, "events"), "event_type", "user_id")


# --- samples -----------------------------------------------------------------

POOL = ", pool AS (SELECT o_orderkey::VARCHAR AS table_uid, 'PMC' || (o_orderkey // 20 + 1) AS pmc_id, o_orderpriority AS class, md5('7:' || o_orderkey) AS lot FROM orders)"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def turns_sql(name: str, used: str, n: int) -> str:
    """A round robin as recursion over turns: the articles used so far travel along."""
    names = "[" + ", ".join(f"'{p}'" for p in PRIORITIES) + "]"
    return f""", {name} AS (SELECT -1 AS turn, {used} AS used, NULL::VARCHAR AS table_uid UNION ALL
    SELECT turn + 1, list_append(used, best.pmc_id), best.table_uid FROM (SELECT t.turn, t.used, arg_min({{'pmc_id': p.pmc_id, 'table_uid': p.table_uid}}, p.lot || p.table_uid) AS best
    FROM {name} t JOIN pool p ON p.class = ({names})[(t.turn + 1) % 5 + 1] AND NOT list_contains(t.used, p.pmc_id) WHERE t.turn < {n - 1} GROUP BY t.turn, t.used))"""


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("table_uid"), "pmc_id", F.col("o_orderpriority").alias("class"))


@query("SELECT DISTINCT pmc_id, CASE WHEN ('0x' || substr(sha1(pmc_id), 26, 15))::BIGINT % 10 < 4 THEN 'dev' ELSE 'test' END AS part FROM (SELECT 'PMC' || (o_orderkey // 20 + 1) AS pmc_id FROM orders)")
def m1_split(spark, sf_dir):
    return pool(spark, sf_dir).select("pmc_id").distinct().select("pmc_id", sampling.split(F.col("pmc_id")).alias("part"))


@query(f"""{FIRST}{GOLD} SELECT d.table_uid, split_part(d.table_uid, '/t', 1) AS pmc_id, n_rows * n_cols AS n_slots, 'h' || hmd || '_v' || vmd AS gold_candidate, CASE WHEN d.table_uid IN (SELECT table_uid FROM aside) THEN 'separator_rows' ELSE 'simple' END AS class FROM dims d JOIN gold g ON g.table_uid = d.table_uid AND hmd IS NOT NULL WHERE n_rows * n_cols <= 40""")
def m2_pool(spark, sf_dir):
    all_ = slots(spark, sf_dir)
    tables = articled(g.shape(all_)).select("table_uid", "pmc_id", F.col("n_slots"))
    named = gold(spark, sf_dir).select("table_uid", F.concat(F.lit("h"), F.col("hmd").cast("string"), F.lit("_v"), F.col("vmd").cast("string")).alias("gold_candidate"))
    return sampling.sampling_pool(tables, named, g.separators(all_).select("table_uid", F.lit("separator_rows").alias("class")).distinct(), 40)


@query(f"WITH x AS (SELECT 1){POOL}, one AS (SELECT table_uid, pmc_id, class FROM pool WHERE class = '1-URGENT' ORDER BY lot, table_uid LIMIT 5), two AS (SELECT table_uid, pmc_id, class FROM pool WHERE class = '2-HIGH' AND pmc_id NOT IN (SELECT pmc_id FROM one) ORDER BY lot, table_uid LIMIT 3) SELECT * FROM one UNION ALL SELECT * FROM two")
def m3_quota_sample(spark, sf_dir):
    return sampling.quota(pool(spark, sf_dir), "class", {"1-URGENT": 5, "2-HIGH": 3}, 7)


@query(f"WITH RECURSIVE x AS (SELECT 1){POOL}{turns_sql('turns', '[]::VARCHAR[]', 40)} SELECT t.table_uid, pmc_id, class, turn AS place FROM turns t JOIN pool p ON p.table_uid = t.table_uid")
def m4_round_robin(spark, sf_dir):
    return sampling.round_robin(pool(spark, sf_dir), "class", PRIORITIES, 40, 7)


@query(f"WITH RECURSIVE x AS (SELECT 1){POOL}{turns_sql('first_', '[]::VARCHAR[]', 5)}{turns_sql('turns', '(SELECT arg_max(used, turn) FROM first_)', 10)} SELECT t.table_uid, pmc_id, class, turn AS place FROM turns t JOIN pool p ON p.table_uid = t.table_uid")
def m5_next_batch(spark, sf_dir):
    all_ = pool(spark, sf_dir)
    return sampling.next_batch(all_, sampling.round_robin(all_, "class", PRIORITIES, 5, 7), "class", PRIORITIES, 10, 7)


@query("""WITH RECURSIVE f AS (SELECT l_partkey AS id, l_linenumber AS query_rank, min(l_orderkey) AS rank FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY ALL),
turns AS (SELECT 0::BIGINT AS q, []::BIGINT[] AS kept, []::BIGINT[] AS mine UNION ALL
    SELECT q + 1, list_concat(kept, new), new FROM (SELECT t.q, t.kept, (list(id::BIGINT ORDER BY rank, id) FILTER (NOT list_contains(t.kept, id)))[1:10] AS new FROM turns t JOIN f ON f.query_rank = t.q + 1 GROUP BY t.q, t.kept))
SELECT unnest(mine) AS id, q AS query_rank, generate_subscripts(mine, 1)::INTEGER AS place FROM turns""")
def m6_first_new(spark, sf_dir):
    found = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("id"), F.col("l_linenumber").cast("long").alias("query_rank"), F.col("l_orderkey").alias("rank"))
    return sampling.first_new(found, read(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("id")), 10)


# --- extraction --------------------------------------------------------------


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_uid, html): the derived tables written as HTML with row and column spans."""
    c = cells(spark, sf_dir)
    spans = F.concat(F.lit(' rowspan="'), (F.col("last_row") - F.col("row_idx") + 1).cast("string"), F.lit('" colspan="'), (F.col("last_col") - F.col("col_idx") + 1).cast("string"), F.lit('"'))
    tag = F.concat(F.lit("<td"), spans, F.lit(">"), "text", F.lit("</td>"))
    rows = c.groupBy("table_uid", "row_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_idx", tag.alias("tag")))), lambda s: s["tag"]), "").alias("row"))
    body = rows.groupBy("table_uid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "row"))), lambda s: F.concat(F.lit("<tr>"), s["row"])), "").alias("body"))
    return body.select("table_uid", F.concat(F.lit("<p>x</p><table>"), "body", F.lit("</table>")).alias("html"))


@query(f"{FIRST} SELECT table_uid, row_idx, col_idx, cell_id FROM slots")
def x3_rasterize(spark, sf_dir):
    found = extract.extract(markup(spark, sf_dir), "table_uid", "html").where("error IS NULL")
    return g.raster_to_slots(found.select(F.col("key").alias("table_uid"), "raster"))


@query(f"{FIRST}, numbered AS (SELECT page_id, html, row_number() OVER (ORDER BY page_id) AS n FROM pages), some_ AS (SELECT table_uid, row_number() OVER (ORDER BY table_uid) AS n FROM dims) SELECT page_id::VARCHAR AS key, 0 AS table_index, NULL::VARCHAR AS error, (SELECT count(*) FROM slots s WHERE s.table_uid = some_.table_uid)::INTEGER AS n_slots FROM numbered JOIN some_ ON some_.n = numbered.n")
def x2_page_tables(spark, sf_dir):
    """The tables of the given pages, each page with a derived table put at the end of its body."""
    number = lambda d, by: evaluate.running(d.withColumn("one", F.lit(1)), ["one"], [F.col(by)], "one").drop("one", "total")
    pages = number(read(spark, sf_dir, "pages").select("page_id", F.col("html").alias("page")), "page_id")
    both = pages.join(number(markup(spark, sf_dir), "table_uid"), "n")
    held = both.select("page_id", F.concat(F.regexp_replace("page", "(?i)</body>.*$", ""), F.col("html")).alias("html"))
    found = extract.extract(held, "page_id", "html")
    return found.select("key", "table_index", "error", F.aggregate("raster", F.lit(0), lambda n, r: n + F.size(r)).alias("n_slots"))


# --- helpers that go table by table ------------------------------------------


@query()
def e4_header_json(spark, sf_dir):
    return export.header_json(export.header_nodes(slots(spark, sf_dir), chosen(spark, sf_dir)), cells(spark, sf_dir))


@query()
def a3_permutation_baseline(spark, sf_dir):
    """Against the mutual information of types and regions, pooled and by table; 1,000 replicates as in the reference."""
    pairs = region_pairs(spark, sf_dir)
    observed = evaluate.mutual_information(pairs).first()["mi"] or 0.0
    macro = evaluate.macro_information(evaluate.mutual_information(pairs, ["table_uid"])).first()["mi"] or 0.0
    return evaluate.permutation_baseline(observed, evaluate.permuted_information(pairs, 1000), macro)


BATCHED = f"{ASKS}, b AS (SELECT text, rule_type, allowed, pmc_id || '/' || ((row_number() OVER w - 1) // 40 + 1) AS batch_id, ((row_number() OVER w - 1) % 40 + 1)::INTEGER AS item FROM reqs WINDOW w AS (PARTITION BY pmc_id ORDER BY text, rule_type))"
SAID = chr(10).join(f"- {t}: {d}" for d, t in rules.SCIENCE.guidelines).replace("'", "''")


def batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guidelines.batches(guidelines.requests(routed(spark, sf_dir), answer_log(spark, sf_dir)))


@query(f"""{FULL}{BATCHED}, m AS (SELECT batch_id, count(DISTINCT allowed) AS n FROM b GROUP BY 1)
SELECT b.batch_id, CASE WHEN any_value(n) > 1 THEN '{guidelines.OPENING.format(guidelines.APART)}' ELSE '{guidelines.OPENING.format(guidelines.ALIKE)}' END || chr(10) || chr(10) || 'Types:' || chr(10) || '{SAID}' || chr(10) || chr(10) || 'Cells:' || chr(10)
|| string_agg(item || '. ' || to_json(text) || CASE WHEN n > 1 THEN ' (allowed: ' || replace(allowed, '|', ', ') || ')' ELSE '' END, chr(10) ORDER BY item) || chr(10) || chr(10) || '{guidelines.CLOSING.format(rules.SCIENCE.guidelines[0][1]).replace("'", "''")}' AS prompt FROM b JOIN m ON m.batch_id = b.batch_id GROUP BY b.batch_id""")
def l4_prompts(spark, sf_dir):
    return guidelines.prompts(batched(spark, sf_dir), rules.SCIENCE)


@query(f"""{FULL}{BATCHED}, r AS (SELECT *, item % 5 AS k, strlen(batch_id) + strpos(batch_id, '/') + item // 40 AS z, right(split_part(batch_id, '/', 1), 1) AS d FROM b),
a AS (SELECT *, CASE WHEN d IN ('0', '1', '2') THEN NULL WHEN k = 0 THEN 'none' WHEN k IN (1, 2) THEN string_split(allowed, '|')[1] END AS answer FROM r),
n AS (SELECT *, count(*) FILTER (answer IS NULL) OVER (PARTITION BY batch_id) AS n_missing, count(*) OVER (PARTITION BY batch_id) AS n FROM a)
SELECT batch_id, item, text, rule_type, answer, n_missing::INTEGER AS n_missing, CASE WHEN d = '0' THEN 'the model call failed or returned nothing' WHEN d = '1' THEN 'the answer is not a JSON object' WHEN n_missing = n THEN 'no cell got one of its allowed types or "none"' END AS retry FROM n""")
def l5_replies(spark, sf_dir):
    """Replies by the article's last digit: none, no object, an empty one, else an answer for three items of five: none, the
    first allowed type, with blanks around it for every other one, and a type that no guideline names for the fourth."""
    asked_ = batched(spark, sf_dir)
    k, d = F.col("item") % 5, F.substring(F.split_part("batch_id", F.lit("/"), F.lit(1)), -1, 1)
    first = F.split("allowed", "\\|")[0]
    value = F.when(k == 0, "none").when(k == 1, first).when(k == 2, F.concat(F.lit("  "), first, F.lit(" "))).when(k == 3, "Nothing")
    entries = F.map_from_entries(F.collect_list(F.when(value.isNotNull(), F.struct(F.col("item").cast("string"), value))))
    made = asked_.groupBy("batch_id").agg(F.to_json(entries).alias("reply")).withColumn("reply", F.when(d == "0", None).when(d == "1", "[1]").when(d == "2", "{}").otherwise(F.col("reply")))
    return guidelines.replies(asked_, made)


@query(f"{FULL} SELECT table_uid, cell_id, type FROM types WHERE cell_id % 40 = 39 AND type <> 'Word'")
def t10_replay_audit(spark, sf_dir):
    """Stored types against recomputed ones, where every fortieth cell of a table is stored as a word: what should be there."""
    computed = typed(spark, sf_dir).select("table_uid", "cell_id", "type")
    stored = computed.withColumn("type", F.when(F.col("cell_id") % 40 == 39, "Word").otherwise(F.col("type")))
    return g.differences(stored, computed).where("side = 'computed'").select("table_uid", "cell_id", "type")


@query("SELECT event_type AS arm, user_id AS table_no, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def a21_scored_twice(spark, sf_dir):
    """Arm and table pairs that pooled runs hold more than once."""
    return evaluate.duplicate_keys(read(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), F.col("user_id").alias("table_no")), "arm", "table_no")


# --- separators and entries --------------------------------------------------


@query(f"{FIRST} SELECT a.table_uid, a.row_idx, text FROM aside a JOIN slots s ON s.table_uid = a.table_uid AND s.row_idx = a.row_idx AND s.col_idx = 0 JOIN cells c ON c.table_uid = s.table_uid AND c.cell_id = s.cell_id")
def e5_separator_texts(spark, sf_dir):
    all_ = slots(spark, sf_dir)
    return export.separator_texts(all_, cells(spark, sf_dir), g.separators(all_))


@query(f"{FIRST}{DECIDED}, torn AS (SELECT DISTINCT f.table_uid, f.candidate_id FROM (SELECT f.table_uid, f.candidate_id, hmd, vmd, s.cell_id, min(row_idx) AS top, min(col_idx) AS a, max(col_idx) AS b FROM found f JOIN slots s ON s.table_uid = f.table_uid AND row_idx < hmd AND col_idx >= vmd GROUP BY ALL) f JOIN slots s ON s.table_uid = f.table_uid AND s.row_idx = top - 1 AND s.col_idx BETWEEN a AND b GROUP BY f.table_uid, f.candidate_id, f.cell_id HAVING count(DISTINCT s.cell_id) > 1), one AS (SELECT table_uid, CASE WHEN event_id % 17 = 0 THEN 'h9_v9' ELSE candidate_id END AS candidate_id, final_status FROM (SELECT *, row_number() OVER (PARTITION BY table_uid ORDER BY event_id) AS n FROM decided) WHERE n = 1) SELECT o.table_uid, final_status, f.candidate_id, f.hmd, f.vmd, CASE WHEN final_status <> 'valid' THEN NULL WHEN f.hmd IS NULL THEN 'unknown_candidate' WHEN t.table_uid IS NOT NULL THEN 'not_a_forest' END AS export_error FROM one o LEFT JOIN found f ON final_status = 'valid' AND f.table_uid = o.table_uid AND f.candidate_id = o.candidate_id LEFT JOIN torn t ON t.table_uid = o.table_uid AND t.candidate_id = o.candidate_id")
def e6_entries(spark, sf_dir):
    """The first review of each table, every seventeenth event's naming a candidate that does not exist."""
    all_, found = slots(spark, sf_dir), candidates(spark, sf_dir)
    said = read_answers(spark, sf_dir).groupBy("table_uid").agg(F.min_by(F.struct("event_id", "verdict", "hmd", "vmd"), "event_id").alias("a")).select("table_uid", "a.*")
    decided = review.decide(said, found, _prior(found).withColumnRenamed("candidate_id", "selected_candidate_id")).join(said.select("table_uid", "event_id"), "table_uid")
    reviews = decided.withColumn("candidate_id", F.when(F.col("event_id") % 17 == 0, "h9_v9").otherwise(F.col("candidate_id")))
    named = found.select("table_uid", "candidate_id", "hmd", "vmd")
    nodes = export.header_nodes_of(all_, named)
    return export.entries(reviews, named, g.shape(all_), nodes)


@query("SELECT coalesce(o.t, e.t) AS table_uid, coalesce(n, 0) AS n_results, o.t IS NOT NULL AS known FROM (SELECT DISTINCT o_custkey::VARCHAR AS t FROM orders WHERE o_custkey % 3 = 0) o FULL JOIN (SELECT user_id::VARCHAR AS t, count(*) AS n FROM events GROUP BY 1) e ON e.t = o.t WHERE coalesce(n, 0) <> 1 OR o.t IS NULL")
def r7_result_audit(spark, sf_dir):
    tables = read(spark, sf_dir, "orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").cast("string").alias("table_uid"))
    return review.result_audit(read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("table_uid")), tables)
