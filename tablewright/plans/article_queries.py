"""Registered queries on articles in files, programs in files, and certificates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import certify, rules
from tablewright.plans import layout_queries as lq
from tablewright.plans.fixtures import cells, shared_dir, slots
from tablewright.plans.record_queries import FIRST, markup
from tablewright.plans.table_queries import ORACLES, TYPES, grid_targets, query
from tablewright.sources import articles, programs, records

# --- articles ----------------------------------------------------------------

#: Where in its wrap a table stands, by its number modulo 4: 0 whole wrap; 1 none; 2 the caption inside the table; 3 a wrap
#: in a wrap, the inner one without a label. Every fifth article's id is another's; names have an unbound prefix in 3.
_written: dict[tuple[str, str], str] = {}


def article_files(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the derived articles, one XML file each in a folder of its name, written once in an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        at = markup(spark, sf_dir).select(F.split_part("table_uid", F.lit("/t"), F.lit(1)).alias("pmc_id"), F.split_part("table_uid", F.lit("/t"), F.lit(2)).cast("int").alias("n"), F.regexp_extract("html", "<table>(.*)</table>", 1).alias("body"))
        table = F.concat(F.lit('<table id="T'), "n", F.lit('">'), F.when(F.col("n") % 4 == 2, F.concat(F.lit("<caption>Own "), "n", F.lit("</caption>"))).otherwise(""), F.regexp_replace("body", "(?s)<tr>(.*?)(?=<tr>|$)", "<tr>$1</tr>"), F.lit("</table>"))
        foot = F.concat(F.lit("<table-wrap-foot><fn-group><fn>a "), "n", F.lit("</fn><fn> </fn></fn-group><p>see<i>text</i></p></table-wrap-foot>"))
        whole = F.concat(F.lit('<table-wrap id="W'), "n", F.lit('"><label>Table '), "n", F.lit("</label><caption><title>Lines</title><p>of <b>order</b></p></caption>"), table, foot, F.lit("</table-wrap>"))
        inner = F.concat(F.lit("<j:table-wrap><label>outer</label><alternatives><table-wrap><caption>In</caption>"), F.regexp_replace(table, "^<table", "<j:table"), F.lit("</table-wrap></alternatives></j:table-wrap>"))
        inner = F.regexp_replace(inner, "</table></table-wrap></alt", "</j:table></table-wrap></alt")
        own = F.concat(F.lit("<table-wrap>"), table, F.lit("</table-wrap>"))
        placed = F.when(F.col("n") % 4 == 0, whole).when(F.col("n") % 4 == 1, table).when(F.col("n") % 4 == 2, own).otherwise(inner)
        part = at.select("pmc_id", "n", placed.alias("x")).groupBy("pmc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]), "").alias("all"))
        number = F.regexp_extract("pmc_id", "[0-9]+", 0)
        id_ = F.when(number.cast("long") % 5 == 0, F.concat(F.lit("PMC"), number, F.lit("0"))).otherwise(number)
        xml = F.concat(F.lit('<article><front><article-meta><article-id pub-id-type="pmcid">'), id_, F.lit("</article-id></article-meta></front><body>"), "all", F.lit("</body></article>"))
        path = f"{shared_dir(spark)}/articles-{uuid.uuid4().hex}"
        part.select("pmc_id", xml.alias("value")).repartition("pmc_id").write.partitionBy("pmc_id").text(path)
        _written[key] = path
    return _written[key]


def read_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.read_articles(spark, f"{article_files(spark, sf_dir)}/*/*.txt")
    return found.withColumn("pmc_id", F.regexp_extract("path", "pmc_id=(PMC[0-9]+)", 1))


@query(f"{FIRST} SELECT split_part(table_uid, '/t', 1) AS pmc_id, true AS whole, count(*)::INTEGER AS n_tables FROM (SELECT DISTINCT table_uid FROM slots) GROUP BY 1")
def s1_article_files(spark, sf_dir):
    """Articles read from their files, one row each: whether size and content are right, and the tables they name."""
    found = read_articles(spark, sf_dir)
    whole = (F.octet_length("xml") == F.col("bytes")) & (F.sha2("xml", 256) == F.col("sha256")) & F.col("xml").endswith("</article>\n")
    return found.select("pmc_id", whole.alias("whole"), F.regexp_count("xml", F.lit('<(j:)?table id=')).alias("n_tables"))


@query(f"""{FIRST}, t AS (SELECT table_uid, split_part(table_uid, '/t', 1) AS key, split_part(table_uid, '/t', 2)::INTEGER AS n, count(*)::INTEGER AS n_slots FROM slots GROUP BY table_uid),
o AS (SELECT *, (row_number() OVER (PARTITION BY key ORDER BY n) - 1)::INTEGER AS table_index FROM t), p AS (SELECT *, '1/2/' || (table_index + 1) AS at_ FROM o)
SELECT key, table_index, CASE n % 4 WHEN 0 THEN at_ || '/3' WHEN 1 THEN at_ WHEN 2 THEN at_ || '/1' ELSE at_ || '/2/1/2' END AS source_path, 'T' || n AS table_id,
    CASE n % 4 WHEN 1 THEN '' WHEN 3 THEN at_ || '/2/1' ELSE at_ END AS wrap_path, CASE n % 4 WHEN 0 THEN 'W' || n ELSE '' END AS wrap_id, CASE n % 4 WHEN 0 THEN 'Table ' || n ELSE '' END AS label,
    CASE n % 4 WHEN 0 THEN 'Lines of order' WHEN 2 THEN 'Own ' || n WHEN 3 THEN 'In' ELSE '' END AS caption, n % 4 IN (0, 3) AS caption_external, CASE n % 4 WHEN 0 THEN 'a ' || n || '|see text' ELSE '' END AS notes, n_slots, NULL::VARCHAR AS error FROM p""")
def x1_article_tables(spark, sf_dir):
    """The tables of the articles with their context."""
    found = articles.article_tables(read_articles(spark, sf_dir), "pmc_id", "xml")
    told = found.select("key", "table_index", "context.*", F.aggregate("raster", F.lit(0), lambda n, r: n + F.size(r)).alias("n_slots"), "error")
    return told.withColumn("notes", F.array_join("notes", "|")).drop("source_table")


@query(f"{FIRST} SELECT pmc_id AS key, CASE WHEN substr(pmc_id, 4)::BIGINT % 5 = 0 THEN 'identity_mismatch' ELSE 'ok' END AS identity FROM (SELECT DISTINCT split_part(table_uid, '/t', 1) AS pmc_id FROM slots)")
def i8_identities(spark, sf_dir):
    return articles.identities(articles.article_ids(read_articles(spark, sf_dir), "pmc_id", "xml"))


# --- programs ----------------------------------------------------------------


def program(spark: SparkSession) -> rules.Program:
    """The rules for scientific tables out of two files, the second imported by the first."""
    path = f"{shared_dir(spark)}/program-{uuid.uuid4().hex}"
    lines = programs.program_lines(rules.SCIENCE)
    programs.write_lines(spark, [x for x in lines if '"rule"' not in x], f"{path}/base.jsonl")
    programs.write_lines(spark, ['{"import": "base.jsonl"}', *[x for x in lines if '"rule"' in x]], f"{path}/science.jsonl")
    return programs.load_program(spark, f"{path}/science.jsonl")


@query()
def t1_program_from_files(spark, sf_dir):
    """Cells typed by a program out of files, with the file and line of the rule that decided, and every ninth cell a gap."""
    gaps = cells(spark, sf_dir).withColumn("kind", F.when(F.col("cell_id") % 9 == 8, "synthetic_gap").otherwise("source"))
    return rules.type_cells(program(spark), gaps.select("table_uid", "cell_id", "text", "kind")).select("table_uid", "cell_id", "type", "family", "source")


#: The line of each rule is its number after the import's; which of several rules of one type decided, the rules tell.
MANY = {r.type for r in rules.SCIENCE.rules if sum(s.type == r.type for s in rules.SCIENCE.rules) > 1}
FIRST_RULE = " ".join(f"WHEN '{r.type}' THEN {k}" for k, r in enumerate(rules.SCIENCE.rules, 2) if r.type not in MANY)


def which_rule() -> str:
    cases = []
    for k, r in enumerate(rules.SCIENCE.rules, 2):
        if r.type in MANY:
            cases.append(f"WHEN type = '{r.type}' AND regexp_full_match(text, '{r.pattern.replace(chr(39), chr(39) * 2)}') THEN {k}")
    return " ".join(cases)


ORACLES["t1_program_from_files"] = f"""{FIRST}{TYPES}, s AS (SELECT text, CASE {which_rule()} ELSE CASE type {FIRST_RULE} END END AS line FROM kinds)
SELECT t.table_uid, t.cell_id, CASE WHEN cell_id % 9 = 8 THEN 'empty' ELSE type END AS type, CASE WHEN cell_id % 9 = 8 THEN 'empty' ELSE family END AS family, CASE WHEN cell_id % 9 = 8 THEN 'synthetic' WHEN type IN ('empty', 'untyped') THEN type ELSE 'science.jsonl:' || line END AS source FROM types t JOIN s ON s.text = t.text"""


# --- certificates -------------------------------------------------------------

#: In lot 1 a header cell lies under two others, so that the graph has paths that no column has.
OVERLAP = "lot = 1 AND row_idx = 1 AND col_idx = 3"


def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    lots = slots(spark, sf_dir).selectExpr("*", f"{lq.LOT} AS lot")
    return lots.selectExpr("table_uid", "row_idx", "col_idx", f"CASE WHEN {OVERLAP} THEN 5 ELSE cell_id END AS cell_id")


@query()
def g18_certificates(spark, sf_dir):
    """Whether boundaries up to (3, 2) label each column, or else each row, by a path of its own."""
    all_ = overlapping(spark, sf_dir)
    return certify.certify(all_, grid_targets(all_))


ORACLES["g18_certificates"] = FIRST.replace("slots AS (SELECT table_uid, row_idx, col_idx, cell_id FROM named)", f"slots AS (SELECT table_uid, row_idx, col_idx, (CASE WHEN {OVERLAP} THEN 5 ELSE cell_id END)::INTEGER AS cell_id FROM (SELECT *, {lq.LOT} AS lot FROM named) x)") + """,
boxes AS (SELECT table_uid, cell_id, min(row_idx) AS r0, max(row_idx) AS r1, min(col_idx) AS c0, max(col_idx) AS c1 FROM slots GROUP BY ALL),
tg AS (SELECT d.table_uid, h.h::INTEGER AS hmd, v.v::INTEGER AS vmd, n_rows, n_cols FROM dims d, range(0, 4) h(h), range(0, 3) v(v)),
shared AS (SELECT t.*, CASE WHEN hmd >= n_rows OR vmd >= n_cols THEN 'boundary_out_of_range' WHEN EXISTS (SELECT 1 FROM boxes b WHERE b.table_uid = t.table_uid AND r0 < hmd AND r1 >= hmd) THEN 'cell_crosses_hmd_line'
    WHEN EXISTS (SELECT 1 FROM boxes b WHERE b.table_uid = t.table_uid AND r1 >= hmd AND c0 < vmd AND c1 >= vmd) THEN 'cell_crosses_vmd_line' END AS why FROM tg t),
turned AS (SELECT table_uid, hmd, vmd, 'c' AS axis, row_idx AS deep, col_idx AS line, cell_id, hmd AS height, vmd AS skip FROM shared s JOIN slots USING (table_uid) WHERE why IS NULL
    UNION ALL SELECT table_uid, hmd, vmd, 'r', col_idx, row_idx, cell_id, vmd, hmd FROM shared s JOIN slots USING (table_uid) WHERE why IS NULL),
heads AS MATERIALIZED (SELECT * FROM turned WHERE deep < height AND line >= skip),
per AS (SELECT table_uid, hmd, vmd, axis, line, string_agg(cell_id::VARCHAR, '>' ORDER BY deep) AS path FROM (SELECT *, lag(cell_id) OVER (PARTITION BY table_uid, hmd, vmd, axis, line ORDER BY deep) AS before FROM heads) WHERE before IS DISTINCT FROM cell_id GROUP BY ALL),
counted AS (SELECT table_uid, hmd, vmd, axis, count(*) AS n_lines, count(DISTINCT path) AS n_distinct FROM per GROUP BY ALL),
e1 AS (SELECT DISTINCT table_uid, hmd, vmd, axis, height, cell_id AS a FROM heads WHERE deep = 0),
step AS (SELECT DISTINCT u.table_uid, u.hmd, u.vmd, u.axis, u.deep, u.cell_id AS a, l.cell_id AS b FROM heads u JOIN heads l ON l.table_uid = u.table_uid AND l.hmd = u.hmd AND l.vmd = u.vmd AND l.axis = u.axis AND l.line = u.line AND l.deep = u.deep + 1),
w2 AS (SELECT e.*, s.b AS c2 FROM e1 e JOIN step s ON s.table_uid = e.table_uid AND s.hmd = e.hmd AND s.vmd = e.vmd AND s.axis = e.axis AND s.deep = 0 AND s.a = e.a WHERE height >= 2),
w3 AS (SELECT w.*, s.b AS c3 FROM w2 w JOIN step s ON s.table_uid = w.table_uid AND s.hmd = w.hmd AND s.vmd = w.vmd AND s.axis = w.axis AND s.deep = 1 AND s.a = w.c2 WHERE height >= 3),
paths_ AS (SELECT table_uid, hmd, vmd, axis, count(*) AS n_paths FROM (SELECT DISTINCT table_uid, hmd, vmd, axis, a, NULL AS c2, NULL AS c3 FROM e1 WHERE height = 1 UNION ALL SELECT DISTINCT table_uid, hmd, vmd, axis, a, c2, NULL FROM w2 WHERE height = 2 UNION ALL SELECT DISTINCT table_uid, hmd, vmd, axis, a, c2, c3 FROM w3) GROUP BY ALL),
judged AS (SELECT s.table_uid, s.hmd, s.vmd, x.axis, CASE WHEN CASE x.axis WHEN 'c' THEN s.hmd ELSE s.vmd END < 1 THEN 'no_header_on_claimed_axis' WHEN n_distinct < n_lines THEN 'lines_share_a_path' WHEN n_paths <> n_lines THEN 'graph_has_paths_without_line' END AS why
    FROM shared s CROSS JOIN (VALUES ('c'), ('r')) x(axis) LEFT JOIN counted c ON c.table_uid = s.table_uid AND c.hmd = s.hmd AND c.vmd = s.vmd AND c.axis = x.axis LEFT JOIN paths_ p ON p.table_uid = s.table_uid AND p.hmd = s.hmd AND p.vmd = s.vmd AND p.axis = x.axis WHERE s.why IS NULL),
both_ AS (SELECT s.table_uid, s.hmd, s.vmd, s.why, max(j.why) FILTER (axis = 'c') AS cw, max(j.why) FILTER (axis = 'r') AS rw FROM shared s LEFT JOIN judged j ON j.table_uid = s.table_uid AND j.hmd = s.hmd AND j.vmd = s.vmd GROUP BY ALL)
SELECT table_uid, hmd, vmd, CASE WHEN why IS NULL AND cw IS NULL THEN 'columns' WHEN why IS NULL AND rw IS NULL THEN 'rows' END AS claim, coalesce(why, cw) AS columns_reason, CASE WHEN coalesce(why, cw) IS NOT NULL THEN coalesce(why, rw) END AS rows_reason FROM both_"""
