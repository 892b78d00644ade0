"""Registered queries on runs, outputs, selection records, ablation lines and cleaned markup, each with its oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions import ids
from tablewright.operators import evaluate, guidelines, rules, scoring
from tablewright.plans.fixtures import cells, kept_by_table, shared_dir, slots
from tablewright.plans.record_queries import DECIDED, FIRST, GOLD, LOG, answer_log, decisions, gold, read, read_answers
from tablewright.plans.table_queries import CHOICE, LINES, candidates, line_cells, oracle, query, typed
from tablewright.sources import articles, markup, records

# --- scores ------------------------------------------------------------------


def listed(found: DataFrame) -> DataFrame:
    """Selection records with their scores as candidate ids and a sum."""
    ids_ = F.array_join(F.transform("scores", lambda s: s["candidate_id"]), ",")
    total = F.aggregate("scores", F.lit(0.0), lambda n, s: n + s["score"])
    return found.select("table_uid", "status", "selected_candidate_id", "selected_by", F.round("margin", 6).alias("margin"), ids_.alias("scored"), F.round(total, 4).alias("total"))


@query()
def c5_header_lines(spark, sf_dir):
    """Every header row and header column as a distribution of its own."""
    return scoring.boundary_costs(slots(spark, sf_dir), candidates(spark, sf_dir), typed(spark, sf_dir), header_model="line").withColumn("bits", F.round("bits", 6))


BY_LINE = LINES.replace("ROLE", "false").replace(
    "UNION ALL SELECT table_uid, candidate_id, region, 0, cell_id FROM labels_ WHERE region <> 'data'",
    "UNION ALL SELECT DISTINCT l.table_uid, candidate_id, region, CASE region WHEN 'hmd' THEN row_idx ELSE col_idx END, l.cell_id FROM labels_ l JOIN slots s ON s.table_uid = l.table_uid AND s.cell_id = l.cell_id WHERE region <> 'data'",
)
oracle("c5_header_lines", BY_LINE + " SELECT table_uid, candidate_id, round(bits, 6) AS bits FROM costs")


@query()
def c10_selections(spark, sf_dir):
    """The selection records by description length."""
    found, types = candidates(spark, sf_dir), typed(spark, sf_dir)
    costs = kept_by_table(scoring.boundary_costs(slots(spark, sf_dir), found, types)).withColumnRenamed("bits", "score")
    return listed(scoring.selections(slots(spark, sf_dir), costs, found, types))


RECORD = """SELECT d.table_uid, CASE WHEN n IS NULL THEN 'no_candidates' WHEN n = 1 THEN 'unique' ELSE 'selected' END AS status, selected_candidate_id, CASE WHEN n = 1 THEN 'only_candidate' WHEN n_tied > 1 THEN 'tie_break' WHEN n > 1 THEN 'score' END AS selected_by,
round(MARGIN, 6) AS margin, CASE WHEN n > 1 THEN scored ELSE '' END AS scored, CASE WHEN n > 1 THEN round(total, 4) ELSE 0 END AS total
FROM dims d LEFT JOIN chosen c ON c.table_uid = d.table_uid LEFT JOIN typed_ t ON t.table_uid = d.table_uid LEFT JOIN (SELECT k.table_uid, string_agg(k.candidate_id, ',' ORDER BY hmd, vmd) AS scored, sum(BITS) AS total FROM keyed k JOIN found f ON f.table_uid = k.table_uid AND f.candidate_id = k.candidate_id GROUP BY 1) s ON s.table_uid = d.table_uid"""
oracle("c10_selections", CHOICE + RECORD.replace("MARGIN", "CASE WHEN gap IS NOT NULL THEN coalesce(gap / n_typed, 0) END").replace("BITS", "bits"))


@query()
def c10_purity_selections(spark, sf_dir):
    """The selection records by purity, the highest first."""
    found, types = candidates(spark, sf_dir), typed(spark, sf_dir)
    scored = scoring.purities(line_cells(spark, sf_dir), types).select("table_uid", "candidate_id", F.col("purity").alias("score"))
    return listed(scoring.selections(slots(spark, sf_dir), kept_by_table(scored), found, types, scorer="purity"))


VIEWS = """, best_ AS (SELECT table_uid, candidate_id, axis, line, max(k) / max(n) AS purity FROM counts_ WHERE axis IN ('col', 'row') GROUP BY ALL),
views AS (SELECT table_uid, candidate_id, avg(purity) FILTER (axis = 'col') AS c, avg(purity) FILTER (axis = 'row') AS r FROM best_ GROUP BY ALL),
scores_ AS (SELECT f.table_uid, f.candidate_id, -coalesce((c + r) / 2, c, r, 0) AS bits FROM found f LEFT JOIN views v ON v.table_uid = f.table_uid AND v.candidate_id = f.candidate_id)"""
PURITY_CHOICE = CHOICE.replace(", keyed AS", f"{VIEWS}, keyed AS").replace("FROM costs c JOIN found", "FROM scores_ c JOIN found")
oracle("c10_purity_selections", PURITY_CHOICE + RECORD.replace("MARGIN", "gap").replace("BITS", "-bits"))


# --- types -------------------------------------------------------------------


@query()
def t7_type_rasters(spark, sf_dir):
    found = rules.type_rasters(slots(spark, sf_dir), typed(spark, sf_dir))
    return found.select("table_uid", F.array_join(F.transform("type_raster", lambda r: F.array_join(r, ",")), "/").alias("types"))


oracle("t7_type_rasters", " SELECT table_uid, string_agg(row_, '/' ORDER BY row_idx) AS types FROM (SELECT s.table_uid, row_idx, string_agg(type, ',' ORDER BY col_idx) AS row_ FROM slots s JOIN types t ON t.table_uid = s.table_uid AND t.cell_id = s.cell_id GROUP BY ALL) GROUP BY 1")


@query()
def t6_sources(spark, sf_dir):
    """What typed each cell: the rule's place in its program, nothing for empty and untyped ones; every ninth cell of a table is a gap."""
    gaps = cells(spark, sf_dir).select("table_uid", "cell_id", "text", F.when(F.col("cell_id") % 9 == 8, "synthetic_gap").otherwise("source").alias("kind"))
    found = rules.type_cells(rules.SCIENCE, gaps)
    of_rule = F.create_map(*[x for k, r in enumerate(rules.SCIENCE.rules) for x in (F.lit(rules.SCIENCE.source(k)), F.lit(r.type))])
    by = F.coalesce(F.try_element_at(of_rule, F.col("source")), F.col("source"))  # a rule is named by its type
    return found.select("table_uid", "cell_id", "type", "family", by.alias("by"))


oracle("t6_sources", " SELECT table_uid, cell_id, CASE WHEN cell_id % 9 = 8 THEN 'empty' ELSE type END AS type, CASE WHEN cell_id % 9 = 8 THEN 'empty' ELSE family END AS family, CASE WHEN cell_id % 9 = 8 THEN 'synthetic' ELSE type END AS by FROM types")


@query()
def t9_ambiguity(spark, sf_dir):
    return rules.ambiguity(rules.SCIENCE, cells(spark, sf_dir).where("text <> ''"))


def matched_sql() -> str:
    """The families of all rules that match a text, a list with an entry for each rule."""
    one = []
    for r in rules.SCIENCE.rules:
        pattern = r.pattern.replace("'", "''")
        test = f"regexp_full_match(text, '{pattern}')"
        if pattern.startswith("(?!"):
            ahead, rest = pattern[3:].split(")\\b)", 1)
            test = f"NOT regexp_matches(text, '^(?:{ahead.removeprefix('(?:')})\\b') AND regexp_full_match(text, '{rest}')"
        one.append(f"CASE WHEN {test} THEN '{rules.SCIENCE.family(r.type)}' END")
    return f"list_filter([{', '.join(one)}], lambda x: x IS NOT NULL)"


oracle("t9_ambiguity", f", m AS (SELECT text, {matched_sql()} AS f FROM texts_ WHERE text <> '') SELECT CASE WHEN len(f) = 0 THEN 'none' WHEN len(f) = 1 THEN 'one_rule' WHEN len(list_distinct(f)) = 1 THEN 'one_family' ELSE 'several_families' END AS matches, count(*) AS n FROM cells c JOIN m ON m.text = c.text GROUP BY 1")


@query(f"WITH x AS (SELECT 1){LOG} SELECT text, rule_type, arg_max(answer, seq) AS answer FROM log WHERE seq % 3 > 0 GROUP BY ALL")
def l6_current_answers(spark, sf_dir):
    """The answers given under the program of today; a third of the log is older."""
    now = guidelines.program_hash(["today"])
    log = answer_log(spark, sf_dir).withColumn("program_sha256", F.when(F.col("seq") % 3 > 0, now).otherwise(guidelines.program_hash(["yesterday"])))
    return guidelines.latest(log, now)


# --- articles ----------------------------------------------------------------


@query("""SELECT page_id, CASE page_id % 10 WHEN 0 THEN 'invalid(empty_body)' WHEN 1 THEN 'ok' WHEN 2 THEN 'ok' WHEN 3 THEN 'invalid(api_error)' WHEN 4 THEN 'invalid(malformed_json)'
WHEN 5 THEN 'rate_limited' WHEN 6 THEN 'invalid(unexpected_json_shape)' WHEN 7 THEN 'invalid(http_error_page)' WHEN 8 THEN 'invalid(unexpected_json_shape)' ELSE 'retryable(server_unavailable)' END AS status FROM pages""")
def i7_json_status(spark, sf_dir):
    """Bodies by the page's number: nothing; a search; a summary; an error beside a list; half of one; a limit; ids that are no
    list; a page of HTML; a summary's body where a search was asked; a server's error."""
    n = F.col("page_id")
    url = F.to_json(F.struct("url"))
    bodies = (
        F.lit(""), F.concat(F.lit('{"esearchresult": {"idlist": ["'), n, F.lit('"]}, "page": '), url, F.lit("}")), F.lit('{"result": {"uids": []}}'), F.lit('{"error": null, "esearchresult": {"idlist": []}}'),
        F.lit('{"esearchresult": {"idlist": ['), F.lit('{"error": "API Rate Limit Exceeded"}'), F.lit('{"esearchresult": {"idlist": "7"}}'), F.lit("<!DOCTYPE HTML><title>x</title>"), F.lit('{"result": {"uids": []}}'), F.lit("502 Bad Gateway"),
    )
    body = F.element_at(F.array(*bodies), (n % 10 + 1).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", ids.json_status(body, F.when(n % 10 == 2, "summary").otherwise("search")).alias("status"))


@query("""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')) AS said FROM documents WHERE text IS NOT NULL)
SELECT doc_id::VARCHAR AS key, CASE doc_id % 4 WHEN 0 THEN 'missing' WHEN 1 THEN NULL ELSE 'evidence_found_unverified' END AS status, CASE doc_id % 4 WHEN 2 THEN 'open' WHEN 3 THEN 'unknown' END AS license_type,
CASE doc_id % 4 WHEN 2 THEN 'http://x/' || doc_id END AS license_url, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN substr('See here ' || said, 1, 1024) ELSE substr(said, 1, 1024) END AS excerpt, true AS hashed FROM t""")
def i9_licences(spark, sf_dir):
    """Articles around the documents: without a licence; no XML; with a licence and a link; with a licence of no type."""
    d = F.col("doc_id")
    said = F.trim(F.regexp_replace("text", "[^A-Za-z0-9]+", " "))
    bodies = (
        F.concat(F.lit("<article><body>"), said, F.lit("</body></article>")), F.lit("<article>"),
        F.concat(F.lit('<article><front><permissions><license license-type="open"><p>See <ext-link xlink:href="http://x/'), d, F.lit('">here</ext-link></p><p>'), said, F.lit('</p></license><license license-type="second"/></permissions></front></article>')),
        F.concat(F.lit("<article><front><license>"), said, F.lit("</license></front></article>")),
    )
    made = read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.element_at(F.array(*bodies), (d % 4 + 1).cast("int")).alias("xml"))
    found = articles.provenance(made, "doc_id", "xml")
    return found.select("key", "license.status", "license.license_type", "license.license_url", F.col("license.license_text_excerpt").alias("excerpt"), ((F.length("sha256") == 64) & (F.col("bytes") > 0)).alias("hashed"))


@query(f"""{FIRST}, t AS (SELECT table_uid, row_idx, string_agg('<td rowspan="' || (last_row - row_idx + 1) || '" colspan="' || (last_col - col_idx + 1) || '"><strong>' || text || '</strong><span>*</span> </td>', '' ORDER BY col_idx) AS row_ FROM cells GROUP BY ALL)
SELECT table_uid, '<table><caption><em>Lines</em></caption>' || string_agg('<tr>' || row_ || '</tr>', '' ORDER BY row_idx) || '</table>' AS html FROM t GROUP BY 1""")
def x14_clean_markup(spark, sf_dir):
    """The derived tables with handlers, scripts, links, unknown elements and spans in other writings, made safe."""
    c = cells(spark, sf_dir)
    across = F.col("last_col") - F.col("col_idx") + 1
    tag = F.concat(F.lit('<td class="c" onclick="go()" rowspan=" 0'), F.col("last_row") - F.col("row_idx") + 1, F.lit('" colspan="'), across, F.lit('" colspan="9" scope="row"><bold id="b">'), "text", F.lit("</bold><a href='http://x'>*</a><script>if (a < b) { bad() }</script><img src=x> <svg><td>no</td></svg>"))
    rows = c.groupBy("table_uid", "row_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_idx", tag.alias("tag")))), lambda s: s["tag"]), "").alias("row"))
    body = rows.groupBy("table_uid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "row"))), lambda s: F.concat(F.lit("<tr style='x'>"), s["row"], F.lit("</tr>"))), "").alias("body"))
    dirty = body.select("table_uid", F.concat(F.lit("<table border=1><!-- no --><caption><italic>Lines</italic></caption>"), "body", F.lit("</table>")).alias("html"))
    return markup.clean_tables(dirty, "html")


# --- runs and outputs --------------------------------------------------------


@query()
def s6_written_selections(spark, sf_dir):
    """Selections written by article, half of the articles again, and read back."""
    found, types = candidates(spark, sf_dir), typed(spark, sf_dir)
    costs = kept_by_table(scoring.boundary_costs(slots(spark, sf_dir), found, types)).withColumnRenamed("bits", "score")
    all_ = kept_by_table(scoring.selections(slots(spark, sf_dir), costs, found, types))
    folder = f"{shared_dir(spark)}/outputs-{uuid.uuid4().hex}"
    half = F.split_part("table_uid", F.lit("/t"), F.lit(1)).endswith("1")
    records.write_output(all_.withColumn("status", F.when(half, "old").otherwise(F.col("status"))), folder, "selections", 16)
    path = records.write_output(all_.where(half), folder, "selections", 16)
    schema = "table_uid string, status string, selected_candidate_id string, selected_by string, margin double, scores array<struct<candidate_id: string, score: double>>"
    return listed(records.read_output(spark, path, schema))


oracle("s6_written_selections", CHOICE + RECORD.replace("MARGIN", "CASE WHEN gap IS NOT NULL THEN coalesce(gap / n_typed, 0) END").replace("BITS", "bits"))

RUNS = """, observed AS (SELECT event_type AS run_id, 'PMC' || (1 + user_id) AS pmc_id, 'q' || (event_id % 5) AS query FROM events WHERE user_id % 7 > 0), proposed AS (SELECT DISTINCT event_type AS run_id, 'PMC' || (1 + user_id) AS pmc_id FROM events WHERE event_id % 3 = 0),
attempts AS (SELECT event_type AS run_id, 'PMC' || (1 + user_id) AS pmc_id, event_id AS seq, CASE WHEN value < 5 THEN 'failed' WHEN value < 20 THEN 'partial' ELSE 'complete' END AS status,
    CASE WHEN value >= 5 THEN NULL WHEN event_id % 4 = 0 THEN 'table ' || (event_id % 9) || ' raster limit columns exceeded (300 > 256)' WHEN event_id % 4 = 1 THEN 'all ' || (event_id % 9) || ' source tables quarantined; no replacement published' WHEN event_id % 4 = 2 THEN 'invalid table layout: ?' ELSE 'time_limit' END AS detail FROM events WHERE event_id % 2 = 0 OR value < 5),
last_ AS (SELECT run_id, pmc_id, arg_max(status, seq) AS status, arg_max(coalesce(detail, ''), seq) AS detail, count(*) AS attempts FROM attempts GROUP BY ALL),
both_ AS (SELECT coalesce(o.run_id, p.run_id) AS run_id, coalesce(o.pmc_id, p.pmc_id) AS pmc_id, CASE WHEN p.run_id IS NULL THEN 'offered' WHEN o.run_id IS NULL THEN 'rejected' ELSE 'selected' END AS decision FROM (SELECT DISTINCT run_id, pmc_id FROM observed) o FULL JOIN proposed p ON p.run_id = o.run_id AND p.pmc_id = o.pmc_id),
papers AS (SELECT b.run_id, b.pmc_id, decision, CASE WHEN decision = 'selected' THEN coalesce(status, 'not_attempted') END AS status, nullif(detail, '') AS detail, coalesce(attempts, 0) AS attempts FROM both_ b LEFT JOIN last_ l ON l.run_id = b.run_id AND l.pmc_id = b.pmc_id)"""


def run_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What the runs' searches gave (run_id, pmc_id, query), and their articles; an event's type is its run."""
    e = F.col("event_id")
    events = read(spark, sf_dir, "events").withColumn("run_id", F.col("event_type")).withColumn("pmc_id", F.concat(F.lit("PMC"), F.col("user_id") + 1))
    observed = events.where("user_id % 7 > 0").select("run_id", "pmc_id", F.concat(F.lit("q"), e % 5).alias("query"))
    error = F.when(F.col("value") < 5, F.element_at(F.array(*[F.lit(x) for x in ("table_raster_limit_exceeded", "all_tables_quarantined", "table_layout_error", "time_limit")]), (e % 4 + 1).cast("int")))
    arguments = F.when(e % 4 == 0, F.array(F.lit("columns"), F.lit("256"), F.lit("300"))).when(e % 4 == 1, F.array((e % 9).cast("string"))).otherwise(F.array().cast("array<string>"))
    detail = records.failure_reason(error, F.when(e % 4 == 0, e % 9), arguments)
    status = F.when(F.col("value") < 5, "failed").when(F.col("value") < 20, "partial").otherwise("complete")
    attempts = events.where("event_id % 2 = 0 OR value < 5").select("run_id", "pmc_id", e.alias("seq"), status.alias("status"), detail.alias("detail"))
    return observed, records.run_papers(observed, events.where("event_id % 3 = 0"), attempts)


@query(f"WITH x AS (SELECT 1){RUNS} SELECT * FROM papers")
def i10_run_papers(spark, sf_dir):
    return run_tables(spark, sf_dir)[1]


@query(f"""WITH x AS (SELECT 1){RUNS} SELECT p.run_id, any_value(q.n) AS queries, {', '.join(f"count(*) FILTER (decision = '{d}') AS {d}" for d in ('offered', 'selected', 'rejected'))}, {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ('complete', 'partial', 'failed', 'not_attempted'))}
FROM papers p JOIN (SELECT run_id, count(DISTINCT query) AS n FROM observed GROUP BY 1) q ON q.run_id = p.run_id GROUP BY 1""")
def i10_run_manifests(spark, sf_dir):
    observed, papers = run_tables(spark, sf_dir)
    return records.run_manifests(read(spark, sf_dir, "events").select(F.col("event_type").alias("run_id")).distinct(), observed, papers)


@query(f"""{FIRST}{DECIDED}{GOLD}, truth AS (SELECT g.table_uid, f.candidate_id AS gold FROM gold g JOIN found f ON f.table_uid = g.table_uid AND f.hmd = g.hmd AND f.vmd = g.vmd),
said AS (SELECT 'full' AS arm, d.table_uid, final_status, CASE verdict WHEN 'confirmed' THEN 'llm' ELSE 'counts' END AS decided_by, d.candidate_id, CASE WHEN final_status = 'valid' THEN d.candidate_id END AS accepted, CASE WHEN final_status = 'valid' AND verdict = 'confirmed' THEN d.candidate_id WHEN verdict = 'counts' THEN 'h' || r.hmd || '_v' || r.vmd END AS llm FROM decided d JOIN read_ r ON r.event_id = d.event_id WHERE d.event_id % 13 > 0
    UNION ALL SELECT 'free', table_uid, CASE verdict WHEN 'counts' THEN 'valid' ELSE 'invalid' END, 'counts', NULL, CASE verdict WHEN 'counts' THEN 'h' || hmd || '_v' || vmd END, CASE verdict WHEN 'counts' THEN 'h' || hmd || '_v' || vmd END FROM read_ WHERE event_id % 5 > 0)
SELECT d.table_uid, a.arm, gold, CASE WHEN s.arm IS NULL THEN 'missing' ELSE 'reviewed' END AS review_status, final_status, decided_by, s.candidate_id AS selected_candidate_id, accepted, llm, accepted = gold AS accepted_correct, llm = gold AS llm_correct
FROM dims d CROSS JOIN (VALUES ('full'), ('free')) a(arm) LEFT JOIN said s ON s.table_uid = d.table_uid AND s.arm = a.arm LEFT JOIN truth t ON t.table_uid = d.table_uid""")
def a15_ablation_lines(spark, sf_dir):
    """Two arms: reviews of proposed candidates, every thirteenth lost, and free answers, every fifth lost."""
    found, answers = candidates(spark, sf_dir), read_answers(spark, sf_dir)
    named = F.when(F.col("verdict") == "counts", F.concat(F.lit("h"), F.col("hmd"), F.lit("_v"), F.col("vmd")))
    proposed = answers.select("table_uid", "event_id", "verdict", named.alias("proposed"))
    by = F.when(F.col("verdict") == "confirmed", "llm").otherwise("counts")
    common = (F.lit("reviewed").alias("review_status"), F.lit(None).cast("string").alias("export_error"))
    full = decisions(spark, sf_dir).join(proposed, "table_uid").where("event_id % 13 > 0").select(F.lit("full").alias("arm"), "table_uid", "final_status", by.alias("decided_by"), F.col("candidate_id").alias("selected_candidate_id"), F.col("candidate_id").alias("candidate"), "proposed", *common)
    none = F.lit(None).cast("string")
    free = proposed.where("event_id % 5 > 0").select(F.lit("free").alias("arm"), "table_uid", F.when(F.col("proposed").isNotNull(), "valid").otherwise("invalid").alias("final_status"), F.lit("counts").alias("decided_by"), none.alias("selected_candidate_id"), none.alias("candidate"), "proposed", *common)
    truth = gold(spark, sf_dir).join(found, ["table_uid", "hmd", "vmd"]).select("table_uid", F.col("candidate_id").alias("gold_candidate"), F.col("candidate_id").alias("gold"))
    return evaluate.ablation_lines(slots(spark, sf_dir), ["full", "free"], full.unionByName(free), truth).drop("export_error", "gold_candidate")
