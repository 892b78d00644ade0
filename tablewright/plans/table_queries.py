"""Registered queries on structure, types and scores, over tables derived from line items, each with SQL that
an independent engine can run on the same files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.text import index_ranges, normalized
from tablewright.operators import geometry as g
from tablewright.operators import rules, scoring
from tablewright.plans.fixtures import FIXTURE_CTES, cells, kept_by_table, slots, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir), with the oracle's statement after the fixture's."""

    def keep(function):
        QUERIES[name or function.__name__] = function
        if sql:
            ORACLES[name or function.__name__] = f"WITH {FIXTURE_CTES}{COMMON} {sql}" if not sql.lstrip().upper().startswith("WITH") else sql
        return function

    return keep


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_by_table(g.candidate_ids(g.boundaries(slots(spark, sf_dir))))


#: What several oracles share: neighbours, sizes, the boundaries by a plain reading of the rules, labels and types.
COMMON = """,
adj AS MATERIALIZED (
    SELECT *, lead(right_id) OVER (PARTITION BY table_uid, col_idx ORDER BY row_idx) AS diagonal_id
    FROM (SELECT *, lead(cell_id) OVER (PARTITION BY table_uid, row_idx ORDER BY col_idx) AS right_id,
                 lead(cell_id) OVER (PARTITION BY table_uid, col_idx ORDER BY row_idx) AS below_id FROM slots) x),
dims AS (SELECT table_uid, max(row_idx) + 1 AS n_rows, max(col_idx) + 1 AS n_cols, count(*) = count(DISTINCT cell_id) AS plain FROM slots GROUP BY table_uid),
grid AS (SELECT table_uid, h.h::INTEGER AS hmd, v.v::INTEGER AS vmd, n_rows, n_cols, plain FROM dims, range(0, 4) h(h), range(0, 3) v(v) WHERE h <= n_rows AND v <= n_cols),
deep AS (SELECT table_uid, min(row_idx) AS rows_ FROM (SELECT table_uid, row_idx FROM adj GROUP BY ALL HAVING NOT coalesce(bool_or(cell_id = right_id AND below_id <> diagonal_id), false)) GROUP BY 1),
wide AS (SELECT table_uid, min(col_idx) AS cols_ FROM (SELECT table_uid, col_idx FROM adj GROUP BY ALL HAVING NOT coalesce(bool_or(cell_id = below_id AND right_id <> diagonal_id), false)) GROUP BY 1),
asked AS (SELECT d.table_uid, h.h::INTEGER AS hmd, v.v::INTEGER AS vmd, n_rows, n_cols, plain
    FROM (SELECT dims.*, least(n_rows, coalesce(rows_, n_rows) + 1) AS most_h, least(n_cols, coalesce(cols_, n_cols) + 1) AS most_v FROM dims LEFT JOIN deep ON deep.table_uid = dims.table_uid LEFT JOIN wide ON wide.table_uid = dims.table_uid) d,
         generate_series(0, most_h) h(h), generate_series(0, most_v) v(v)),
broken AS (
    SELECT DISTINCT a.table_uid, hmd, vmd FROM asked a JOIN adj s ON s.table_uid = a.table_uid
    WHERE (row_idx >= hmd AND col_idx = vmd - 1 AND cell_id = right_id) OR (row_idx = hmd - 1 AND cell_id = below_id)
       OR (row_idx < hmd - 1 AND col_idx >= vmd AND cell_id <> right_id AND below_id = diagonal_id)
       OR (col_idx < vmd - 1 AND row_idx >= hmd - 1 AND cell_id <> below_id AND right_id = diagonal_id)
       OR (row_idx = hmd - 1 AND col_idx >= vmd - 1 AND cell_id = right_id)
    UNION
    SELECT a.table_uid, hmd, vmd FROM asked a JOIN adj s ON s.table_uid = a.table_uid WHERE row_idx < hmd - 1
    GROUP BY a.table_uid, hmd, vmd, row_idx HAVING NOT coalesce(bool_or(col_idx >= vmd AND cell_id = right_id AND below_id <> diagonal_id), false)
    UNION
    SELECT a.table_uid, hmd, vmd FROM asked a JOIN adj s ON s.table_uid = a.table_uid WHERE col_idx < vmd - 1
    GROUP BY a.table_uid, hmd, vmd, col_idx HAVING NOT coalesce(bool_or(row_idx >= hmd AND cell_id = below_id AND right_id <> diagonal_id), false)),
found AS MATERIALIZED (
    SELECT table_uid, hmd, vmd, 'h' || hmd || '_v' || vmd AS candidate_id FROM asked a
    WHERE hmd + vmd > 0 AND hmd < n_rows AND vmd < n_cols AND (hmd > 0 OR plain)
      AND NOT EXISTS (SELECT 1 FROM broken b WHERE b.table_uid = a.table_uid AND b.hmd = a.hmd AND b.vmd = a.vmd)),
labels_ AS (
    SELECT f.table_uid, candidate_id, cell_id, hmd, vmd, CASE WHEN row_idx < hmd THEN 'hmd' WHEN col_idx < vmd THEN 'vmd' ELSE 'data' END AS region
    FROM found f JOIN cells c ON c.table_uid = f.table_uid),
aside AS (SELECT table_uid, row_idx FROM slots GROUP BY table_uid, row_idx HAVING count(DISTINCT cell_id) = 1 AND count(*) > 1)"""


@query("SELECT table_uid, cell_id, min(row_idx) AS first_row, max(row_idx) AS last_row, min(col_idx) AS first_col, max(col_idx) AS last_col, count(*) AS n_slots, count(*) = (max(row_idx) - min(row_idx) + 1) * (max(col_idx) - min(col_idx) + 1) AS filled FROM slots GROUP BY ALL")
def x11_cell_extents(spark, sf_dir):
    return g.extents(slots(spark, sf_dir))


@query("SELECT table_uid, string_agg(ids, '/' ORDER BY row_idx) AS raster FROM (SELECT table_uid, row_idx, string_agg(cell_id::VARCHAR, ',' ORDER BY col_idx) AS ids FROM slots GROUP BY ALL) GROUP BY table_uid")
def x10_slots_to_raster(spark, sf_dir):
    again = g.raster_to_slots(g.slots_to_raster(slots(spark, sf_dir)))  # there and back
    return g.slots_to_raster(again).select("table_uid", F.array_join(F.transform("raster", lambda r: F.array_join(F.transform(r, lambda x: x.cast("string")), ",")), "/").alias("raster"))


@query("SELECT table_uid, cell_id, row_idx, col_idx, text FROM cells")
def x9_cells(spark, sf_dir):
    named = texts(spark, sf_dir)
    top = named.groupBy("table_uid", "cell_id").agg(F.min(F.struct("row_idx", "col_idx")).alias("top"), F.max("text").alias("text"))
    return top.select("table_uid", "cell_id", "top.row_idx", "top.col_idx", "text")


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\x{00A0}]+', ' ', 'g')) AS text FROM documents")
def x12_normalize_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", normalized(F.col("text")).alias("text"))


@query("SELECT table_uid, (max(row_idx) + 1)::INTEGER AS n_rows, (max(col_idx) + 1)::INTEGER AS n_cols, count(*) AS n_slots, count(DISTINCT cell_id) AS n_cells, CASE WHEN max(row_idx) + 1 > 1000 THEN 'n_rows' WHEN max(col_idx) + 1 > 256 THEN 'n_cols' WHEN count(DISTINCT cell_id) > 10000 THEN 'n_cells' WHEN count(*) > 100000 THEN 'n_slots' END AS over_budget FROM slots GROUP BY table_uid")
def x5_table_budget(spark, sf_dir):
    return g.table_budget(g.shape(slots(spark, sf_dir))).select("table_uid", "n_rows", "n_cols", "n_slots", "n_cells", "over_budget")


@query("SELECT pmc_id, table_index, sum(n_slots) OVER w AS slots_so_far, count(*) OVER w AS tables_so_far, sum(n_slots) OVER w <= 250000 AND count(*) OVER w <= 256 AS within FROM (SELECT split_part(table_uid, '/t', 1) AS pmc_id, split_part(table_uid, '/t', 2)::INTEGER AS table_index, count(*) AS n_slots FROM slots GROUP BY ALL) WINDOW w AS (PARTITION BY pmc_id ORDER BY table_index)".replace("sum(n_slots) OVER w AS", "(sum(n_slots) OVER w)::BIGINT AS"))
def x6_article_budget(spark, sf_dir):
    shapes = g.shape(slots(spark, sf_dir))
    return g.article_budget(shapes.select(F.split_part("table_uid", F.lit("/t"), F.lit(1)).alias("pmc_id"), F.split_part("table_uid", F.lit("/t"), F.lit(2)).cast("int").alias("table_index"), "n_slots"))


@query("SELECT f.table_uid, count(*) AS n_candidates, any_value(c.n) AS n_cells, count(*) * any_value(c.n) AS n_labels FROM found f JOIN (SELECT table_uid, count(*) AS n FROM cells GROUP BY 1) c ON c.table_uid = f.table_uid GROUP BY 1 HAVING count(*) * any_value(c.n) <= 500000")
def x7_label_budget(spark, sf_dir):
    all_ = slots(spark, sf_dir)
    return g.label_budget(g.boundaries(all_), g.shape(all_))


@query("SELECT table_uid, (max(row_idx) + 1)::INTEGER AS n_rows, (max(col_idx) + 1)::INTEGER AS n_cols, count(*) = (max(row_idx) + 1) * (max(col_idx) + 1) AS rectangular FROM slots GROUP BY 1")
def g1_shape(spark, sf_dir):
    return g.shape(slots(spark, sf_dir)).select("table_uid", "n_rows", "n_cols", "rectangular")


@query("SELECT table_uid, row_idx, col_idx, cell_id, right_id, below_id, diagonal_id FROM adj")
def g2_adjacency(spark, sf_dir):
    return g.adjacency(slots(spark, sf_dir))


@query("SELECT table_uid, plain FROM dims")
def g3_plain_grids(spark, sf_dir):
    return g.plain_grids(slots(spark, sf_dir))


@query("SELECT table_uid, row_idx, coalesce(max(col_idx) FILTER (cell_id = right_id), -1) AS same, coalesce(max(col_idx) FILTER (cell_id = below_id), -1) AS crossing, coalesce(max(col_idx) FILTER (cell_id = right_id AND below_id <> diagonal_id), -1) AS split, coalesce(max(col_idx) FILTER (cell_id <> right_id AND below_id = diagonal_id), -1) AS joined FROM adj GROUP BY ALL")
def g4_row_summaries(spark, sf_dir):
    return g.row_summaries(g.adjacency(slots(spark, sf_dir)))


@query("SELECT table_uid, col_idx, crossing, split, joined, coalesce(min(split) OVER w, n_rows)::INTEGER AS least_split, coalesce(max(joined) OVER w, -1)::INTEGER AS most_joined FROM (SELECT a.table_uid, col_idx, any_value(n_rows) AS n_rows, coalesce(max(row_idx) FILTER (cell_id = right_id), -1) AS crossing, coalesce(max(row_idx) FILTER (cell_id = below_id AND right_id <> diagonal_id), -1) AS split, coalesce(max(row_idx) FILTER (cell_id <> below_id AND right_id = diagonal_id), -1) AS joined FROM adj a JOIN dims d ON d.table_uid = a.table_uid GROUP BY a.table_uid, col_idx) WINDOW w AS (PARTITION BY table_uid ORDER BY col_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def g5_prefix_summaries(spark, sf_dir):
    all_ = slots(spark, sf_dir)
    size = all_.groupBy("table_uid").agg((F.max("row_idx") + 1).alias("n_rows"))
    return g.earlier(g.column_summaries(g.adjacency(all_)).join(size, "table_uid"), "col_idx", "n_rows").drop("n_rows")


@query("SELECT table_uid, hmd, vmd FROM found")
def g6_boundaries(spark, sf_dir):
    return g.boundaries(slots(spark, sf_dir))


def grid_targets(all_: DataFrame) -> DataFrame:
    """Boundaries from (0, 0) to (3, 2) of every table."""
    tables = all_.select("table_uid").distinct()
    return tables.select("table_uid", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("hmd")).select("table_uid", "hmd", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("vmd"))


RULES_SQL = """, t AS (SELECT * FROM grid),
far AS (SELECT table_uid, h.h::INTEGER AS hmd, v.v::INTEGER AS vmd, n_rows, n_cols, plain FROM dims, range(0, 4) h(h), range(0, 3) v(v) WHERE h > n_rows OR v > n_cols),
t2 AS (SELECT * FROM t UNION ALL SELECT * FROM far),
one AS (SELECT t2.table_uid, hmd, vmd,
    coalesce(bool_or(row_idx >= hmd AND col_idx = vmd - 1 AND cell_id = right_id), false) AS rule_0,
    coalesce(bool_or(row_idx = hmd - 1 AND cell_id = below_id), false) AS rule_1,
    coalesce(bool_or(row_idx < hmd - 1 AND col_idx >= vmd AND cell_id <> right_id AND below_id = diagonal_id), false) AS rule_4,
    coalesce(bool_or(col_idx < vmd - 1 AND row_idx >= hmd - 1 AND cell_id <> below_id AND right_id = diagonal_id), false) AS rule_5,
    coalesce(bool_or(row_idx = hmd - 1 AND col_idx >= vmd - 1 AND cell_id = right_id), false) AS rule_6,
    hmd = 0 AND vmd = 0 AS rule_7, hmd >= any_value(n_rows) OR vmd >= any_value(n_cols) AS rule_8, hmd = 0 AND NOT any_value(plain) AS rule_9,
    hmd > any_value(n_rows) OR vmd > any_value(n_cols) AS outside
    FROM t2 JOIN adj s ON s.table_uid = t2.table_uid GROUP BY t2.table_uid, hmd, vmd),
two AS (SELECT o.*, EXISTS (SELECT 1 FROM adj s WHERE s.table_uid = o.table_uid AND row_idx < hmd - 1 GROUP BY row_idx HAVING NOT coalesce(bool_or(col_idx >= vmd AND cell_id = right_id AND below_id <> diagonal_id), false)) AS rule_2,
    EXISTS (SELECT 1 FROM adj s WHERE s.table_uid = o.table_uid AND col_idx < vmd - 1 GROUP BY col_idx HAVING NOT coalesce(bool_or(row_idx >= hmd AND cell_id = below_id AND right_id <> diagonal_id), false)) AS rule_3 FROM one o),
checked AS (SELECT *, CASE WHEN outside THEN -2 WHEN rule_7 THEN 7 WHEN rule_8 THEN 8 WHEN rule_9 THEN 9 WHEN rule_0 THEN 0 WHEN rule_1 THEN 1 WHEN rule_2 THEN 2 WHEN rule_3 THEN 3 WHEN rule_4 THEN 4 WHEN rule_5 THEN 5 WHEN rule_6 THEN 6 ELSE -1 END AS first_broken FROM two)"""


@query("SELECT table_uid, hmd, vmd, rule_0, rule_1, rule_2, rule_3, rule_4, rule_5, rule_6, rule_7, rule_8, rule_9, first_broken FROM checked")
def g7_rule_checks(spark, sf_dir):
    all_ = slots(spark, sf_dir)
    return g.rule_checks(all_, grid_targets(all_))


ORACLES["g7_rule_checks"] = ORACLES["g7_rule_checks"].replace("SELECT table_uid, hmd, vmd, rule_0, rule_1, rule_2", RULES_SQL + " SELECT table_uid, hmd, vmd, rule_0, rule_1, rule_2")


@query("SELECT first_broken, count(*) AS n FROM checked GROUP BY 1")
def r16_rule_counts(spark, sf_dir):
    all_ = slots(spark, sf_dir)
    return g.rule_checks(all_, grid_targets(all_)).groupBy("first_broken").agg(F.count("*").alias("n"))


ORACLES["r16_rule_counts"] = ORACLES["r16_rule_counts"].replace("SELECT first_broken, count", RULES_SQL + " SELECT first_broken, count")


@query("SELECT table_uid, row_idx FROM aside")
def g9_separators(spark, sf_dir):
    return g.separators(slots(spark, sf_dir))


@query("SELECT f.table_uid, hmd, vmd, row_idx FROM found f JOIN slots s ON s.table_uid = f.table_uid AND row_idx >= hmd AND col_idx >= vmd GROUP BY ALL HAVING count(DISTINCT cell_id) = 1 AND count(*) > 1")
def g10_region_separators(spark, sf_dir):
    all_ = slots(spark, sf_dir)
    return g.region_separators(all_, g.boundaries(all_))


@query("SELECT table_uid, (dense_rank() OVER (PARTITION BY table_uid ORDER BY row_idx) - 1)::INTEGER AS row_idx, col_idx, cell_id, row_idx AS source_row FROM slots s WHERE NOT EXISTS (SELECT 1 FROM aside a WHERE a.table_uid = s.table_uid AND a.row_idx = s.row_idx)")
def g11_strip_separators(spark, sf_dir):
    return g.strip_separators(slots(spark, sf_dir))


@query("SELECT table_uid, candidate_id, hmd, vmd, (row_number() OVER (PARTITION BY table_uid ORDER BY hmd, vmd) - 1)::INTEGER AS ord FROM found")
def g13_candidate_ids(spark, sf_dir):
    return candidates(spark, sf_dir).select("table_uid", "candidate_id", "hmd", "vmd", "ord")


@query("SELECT d.table_uid, coalesce(n, 0) AS n_candidates, CASE coalesce(n, 0) WHEN 0 THEN 'abstained' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM dims d LEFT JOIN (SELECT table_uid, count(*) AS n FROM found GROUP BY 1) f ON f.table_uid = d.table_uid")
def g14_statuses(spark, sf_dir):
    all_ = slots(spark, sf_dir)
    return g.statuses(all_, g.boundaries(all_))


@query("SELECT table_uid, candidate_id, cell_id, region FROM labels_")
def g15_labels(spark, sf_dir):
    return g.labels(candidates(spark, sf_dir), cells(spark, sf_dir))


@query()
def g17_boundary_regions(spark, sf_dir):
    all_ = slots(spark, sf_dir)
    size = g.shape(all_)
    targets = grid_targets(all_).join(size, "table_uid").where("hmd <= n_rows AND vmd <= n_cols")
    regions = g.boundary_regions(all_, targets.select("table_uid", "hmd", "vmd"))
    return regions.groupBy("table_uid", "hmd", "vmd", "region").agg(F.count("*").alias("n_cells"))


ORACLES["g17_boundary_regions"] = f"""WITH {FIXTURE_CTES}{COMMON},
lab AS (SELECT s.table_uid, hmd, vmd, cell_id, min(CASE WHEN row_idx < hmd THEN 'hmd' WHEN col_idx < vmd THEN 'vmd' ELSE 'data' END) AS region,
               count(DISTINCT CASE WHEN row_idx < hmd THEN 'hmd' WHEN col_idx < vmd THEN 'vmd' ELSE 'data' END) AS kinds
        FROM slots s JOIN grid a ON a.table_uid = s.table_uid GROUP BY s.table_uid, hmd, vmd, cell_id)
SELECT table_uid, hmd, vmd, region, count(*) AS n_cells FROM (SELECT *, max(kinds) OVER (PARTITION BY table_uid, hmd, vmd) AS worst FROM lab) WHERE worst = 1 GROUP BY ALL"""

PATHS_SQL = """SELECT table_uid, candidate_id, col_idx AS line, string_agg(cell_id::VARCHAR, '>' ORDER BY row_idx) AS path
FROM (SELECT f.table_uid, candidate_id, col_idx, row_idx, cell_id, lag(cell_id) OVER (PARTITION BY f.table_uid, candidate_id, col_idx ORDER BY row_idx) AS before
      FROM found f JOIN slots s ON s.table_uid = f.table_uid AND row_idx < hmd AND col_idx >= vmd) WHERE before IS DISTINCT FROM cell_id GROUP BY ALL"""


@query(PATHS_SQL)
def g19_column_paths(spark, sf_dir):
    paths = g.column_paths(slots(spark, sf_dir), candidates(spark, sf_dir))
    return paths.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


@query(f"SELECT table_uid, candidate_id, count(*) AS n_lines, count(*) = count(DISTINCT path) AS distinct_paths FROM ({PATHS_SQL}) GROUP BY ALL")
def g18_distinct_paths(spark, sf_dir):
    return g.distinct_paths(g.column_paths(slots(spark, sf_dir), candidates(spark, sf_dir)))


@query("SELECT table_uid, cell_id, 'stored' AS side FROM cells WHERE cell_id % 50 = 49")
def g21_record_audit(spark, sf_dir):
    """Stored cells against cells computed from the slots, where every fiftieth cell of a table is stored moved by a row."""
    all_ = slots(spark, sf_dir)
    computed = all_.groupBy("table_uid", "cell_id").agg(F.min("row_idx").alias("row_idx"), F.min("col_idx").alias("col_idx"))
    stored = computed.withColumn("row_idx", F.col("row_idx") + F.when(F.col("cell_id") % 50 == 49, 1).otherwise(0))
    return g.differences(stored, computed).where("side = 'stored'").select("table_uid", "cell_id", "side")


# --- types -------------------------------------------------------------------


def types_sql() -> str:
    """The rules as the oracle's CASE. Its expressions know no look-ahead, so that one rule is split in two."""
    cases = []
    for r in rules.SCIENCE.rules:
        pattern = r.pattern.replace("'", "''")
        if pattern.startswith("(?!"):
            ahead, rest = pattern[3:].split(")\\b)", 1)
            cases.append(f"WHEN NOT regexp_matches(text, '^(?:{ahead.removeprefix('(?:')})\\b') AND regexp_full_match(text, '{rest}') THEN '{r.type}'")
        else:
            cases.append(f"WHEN regexp_full_match(text, '{pattern}') THEN '{r.type}'")
    families = " ".join(f"WHEN '{t}' THEN '{rules.SCIENCE.family(t)}'" for t in rules.SCIENCE.types())
    groups = " ".join(f"WHEN '{t}' THEN '{rules.SCIENCE.group(t)}'" for t in rules.SCIENCE.types())
    return f""", texts_ AS (SELECT DISTINCT text FROM cells), known AS MATERIALIZED (SELECT text, CASE WHEN text = '' THEN 'empty' {' '.join(cases)} ELSE 'untyped' END AS type FROM texts_),
kinds AS MATERIALIZED (SELECT text, type, CASE type {families} ELSE type END AS family, CASE type {groups} ELSE type END AS grp FROM known),
types AS MATERIALIZED (SELECT c.table_uid, c.cell_id, c.text, type, family, grp FROM cells c JOIN kinds k ON k.text = c.text)"""


TYPES = types_sql()


def typed(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """Types of all cells, with their texts if asked for."""
    found = rules.type_cells(rules.SCIENCE, cells(spark, sf_dir).select("table_uid", "cell_id", "text"))
    return kept_by_table(found if text else found.drop("text"))


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = f"WITH {FIXTURE_CTES}{COMMON}{TYPES}{sql}"


@query()
def t2_cell_types(spark, sf_dir):
    return typed(spark, sf_dir).select("table_uid", "cell_id", "type", "family", F.col("group").alias("grp"))


oracle("t2_cell_types", " SELECT table_uid, cell_id, type, family, grp FROM types")


@query()
def t3_typed_texts(spark, sf_dir):
    return rules.type_texts(rules.SCIENCE, cells(spark, sf_dir)).select("text", "type", "family")


oracle("t3_typed_texts", " SELECT text, type, family FROM kinds")


@query()
def t7_type_records(spark, sf_dir):
    return rules.type_records(typed(spark, sf_dir, text=True)).select("table_uid", "n_cells", "typed", "untyped", "empty")


oracle("t7_type_records", " SELECT table_uid, count(*) AS n_cells, count(*) FILTER (family NOT IN ('empty', 'untyped')) AS typed, count(*) FILTER (family = 'untyped') AS untyped, count(*) FILTER (family = 'empty') AS empty FROM types GROUP BY 1")


@query()
def t8_coverage(spark, sf_dir):
    return rules.coverage(rules.type_records(typed(spark, sf_dir, text=True))).select(F.round("untyped_share", 9).alias("untyped_share"))


oracle("t8_coverage", " SELECT round(count(*) FILTER (family = 'untyped') / count(*) FILTER (family <> 'empty'), 9) AS untyped_share FROM types")


@query()
def t9_type_distribution(spark, sf_dir):
    return rules.distribution(typed(spark, sf_dir)).withColumn("share", F.round("share", 9))


oracle("t9_type_distribution", " SELECT family, type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM types GROUP BY 1, 2")


# --- scores ------------------------------------------------------------------

LINES = """, lines_ AS (
    SELECT DISTINCT l.table_uid, candidate_id, 'col' AS axis, col_idx AS line, l.cell_id FROM labels_ l JOIN slots s ON s.table_uid = l.table_uid AND s.cell_id = l.cell_id WHERE region = 'data'
    UNION ALL SELECT DISTINCT l.table_uid, candidate_id, 'row', row_idx, l.cell_id FROM labels_ l JOIN slots s ON s.table_uid = l.table_uid AND s.cell_id = l.cell_id WHERE region = 'data'
    UNION ALL SELECT table_uid, candidate_id, region, 0, cell_id FROM labels_ WHERE region <> 'data'),
counts_ AS (SELECT l.table_uid, candidate_id, axis, line, family AS kind, count(*) AS k, sum(count(*)) OVER (PARTITION BY l.table_uid, candidate_id, axis, line) AS n
    FROM lines_ l JOIN types t ON t.table_uid = l.table_uid AND t.cell_id = l.cell_id WHERE family NOT IN ('empty', 'untyped', 'Missing') AND NOT (axis = 'row' AND ROLE) GROUP BY l.table_uid, candidate_id, axis, line, family),
typed_ AS (SELECT table_uid, count(*) AS n_typed FROM types WHERE family NOT IN ('empty', 'untyped', 'Missing') GROUP BY 1),
bits_ AS (SELECT c.table_uid, candidate_id, axis, line, sum(-k * log2(k / n)) + 0.5 * log2(greatest(any_value(n_typed), 2)) AS bits FROM counts_ c JOIN typed_ t ON t.table_uid = c.table_uid GROUP BY ALL),
costs AS (SELECT table_uid, candidate_id, sum(CASE WHEN axis IN ('col', 'row') THEN bits / 2 ELSE bits END) AS bits FROM bits_ GROUP BY ALL)"""
PLAIN = LINES.replace("ROLE", "false")


def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.lines(slots(spark, sf_dir), g.labels(candidates(spark, sf_dir), cells(spark, sf_dir)))


@query()
def c1_lines(spark, sf_dir):
    return line_cells(spark, sf_dir).groupBy("table_uid", "candidate_id", "axis", "line").agg(F.count("*").alias("n_cells"), F.sum("cell_id").alias("ids"))


oracle("c1_lines", PLAIN + " SELECT table_uid, candidate_id, axis, line, count(*) AS n_cells, sum(cell_id)::BIGINT AS ids FROM lines_ GROUP BY ALL")


@query()
def c3_line_counts(spark, sf_dir):
    return scoring.line_counts(line_cells(spark, sf_dir), typed(spark, sf_dir))


oracle("c3_line_counts", PLAIN + " SELECT table_uid, candidate_id, axis, line, kind, k, n::BIGINT AS n FROM counts_")


@query()
def c4_bit_costs(spark, sf_dir):
    return scoring.bit_costs(line_cells(spark, sf_dir), typed(spark, sf_dir)).withColumn("bits", F.round("bits", 6))


oracle("c4_bit_costs", PLAIN + " SELECT table_uid, candidate_id, round(bits, 6) AS bits FROM costs")


@query()
def c5_bit_costs_with_roles(spark, sf_dir):
    """Fine types, with words as the role of row names."""
    return scoring.bit_costs(line_cells(spark, sf_dir), typed(spark, sf_dir), roles=("Word",)).withColumn("bits", F.round("bits", 6))


oracle("c5_bit_costs_with_roles", LINES.replace("ROLE", "type = 'Word'") + """, extra AS (SELECT l.table_uid, candidate_id, count(DISTINCT l.cell_id) * 0.5 * log2(greatest(any_value(n_typed), 2)) AS extra
    FROM lines_ l JOIN types t ON t.table_uid = l.table_uid AND t.cell_id = l.cell_id JOIN typed_ y ON y.table_uid = l.table_uid WHERE axis = 'vmd' AND type = 'Word' GROUP BY ALL)
SELECT c.table_uid, c.candidate_id, round(c.bits + coalesce(extra, 0), 6) AS bits FROM costs c LEFT JOIN extra e ON e.table_uid = c.table_uid AND e.candidate_id = c.candidate_id""")


@query()
def c6_purities(spark, sf_dir):
    found = scoring.purities(line_cells(spark, sf_dir), typed(spark, sf_dir))
    return found.select("table_uid", "candidate_id", *[F.round(c, 6).alias(c) for c in ("column_purity", "row_purity", "purity")])


oracle("c6_purities", PLAIN + """, best AS (SELECT table_uid, candidate_id, axis, line, max(k) / max(n) AS purity FROM counts_ WHERE axis IN ('col', 'row') GROUP BY ALL),
views AS (SELECT table_uid, candidate_id, avg(purity) FILTER (axis = 'col') AS column_purity, avg(purity) FILTER (axis = 'row') AS row_purity FROM best GROUP BY ALL)
SELECT table_uid, candidate_id, round(column_purity, 6) AS column_purity, round(row_purity, 6) AS row_purity, round(coalesce((column_purity + row_purity) / 2, column_purity, row_purity, 0), 6) AS purity FROM views""")

CHOICE = PLAIN + """, keyed AS (SELECT c.table_uid, c.candidate_id, bits, abs(hmd - 1) + abs(vmd - 1) AS steps, min(bits) OVER (PARTITION BY c.table_uid) AS least, count(*) OVER (PARTITION BY c.table_uid) AS n, row_number() OVER (PARTITION BY c.table_uid ORDER BY bits) AS place
    FROM costs c JOIN found f ON f.table_uid = c.table_uid AND f.candidate_id = c.candidate_id),
chosen AS (SELECT table_uid, arg_min(candidate_id, (bits - least > 1e-9, steps, candidate_id)) AS selected_candidate_id, any_value(n) AS n, count(*) FILTER (bits - least <= 1e-9) AS n_tied,
    CASE WHEN any_value(n) > 1 THEN min(bits) FILTER (place = 2) - min(bits) END AS gap FROM keyed GROUP BY table_uid)"""


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boundary of every table by the description length of its cell types."""
    found, types = candidates(spark, sf_dir), typed(spark, sf_dir)
    costs = kept_by_table(scoring.boundary_costs(slots(spark, sf_dir), found, types))
    return scoring.select(costs.withColumnRenamed("bits", "score"), found)


@query()
def c7_selection(spark, sf_dir):
    return selected(spark, sf_dir).select("table_uid", "selected_candidate_id", "status", "selected_by", F.round("gap", 6).alias("gap"))


oracle("c7_selection", CHOICE + " SELECT table_uid, selected_candidate_id, CASE n WHEN 1 THEN 'unique' ELSE 'selected' END AS status, CASE WHEN n = 1 THEN 'only_candidate' WHEN n_tied > 1 THEN 'tie_break' ELSE 'score' END AS selected_by, round(gap, 6) AS gap FROM chosen")


@query()
def c9_margins(spark, sf_dir):
    return scoring.margins(selected(spark, sf_dir), typed(spark, sf_dir)).withColumn("margin", F.round("margin", 6))


oracle("c9_margins", CHOICE + " SELECT c.table_uid, round(CASE WHEN gap IS NOT NULL THEN coalesce(gap / n_typed, 0) END, 6) AS margin FROM chosen c LEFT JOIN typed_ t ON t.table_uid = c.table_uid")


@query()
def c12_abstaining_selection(spark, sf_dir):
    return scoring.abstaining(selected(spark, sf_dir))


oracle("c12_abstaining_selection", CHOICE + " SELECT table_uid, CASE n_tied WHEN 1 THEN selected_candidate_id END AS selected_candidate_id FROM chosen")


@query("SELECT table_uid, first(candidate_id ORDER BY vmd <> 1, hmd < 1, hmd, abs(hmd - 1) + abs(vmd - 1), candidate_id) AS selected_candidate_id FROM found GROUP BY 1")
def c11_prior_choice(spark, sf_dir):
    return scoring.prior_choice(candidates(spark, sf_dir))


@query("SELECT count(*) AS n_tables, round(sum(1 / n), 6) AS expected FROM (SELECT table_uid, count(*) AS n FROM found GROUP BY 1)")
def c11_random_expectation(spark, sf_dir):
    return scoring.random_expectation(candidates(spark, sf_dir)).withColumn("expected", F.round("expected", 6))


@query("SELECT table_uid, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM (SELECT table_uid, min(row_idx) AS a, max(row_idx) AS b FROM (SELECT table_uid, row_idx, row_idx - row_number() OVER (PARTITION BY table_uid ORDER BY row_idx) AS island FROM aside) GROUP BY table_uid, island) GROUP BY table_uid")
def r4_index_ranges(spark, sf_dir):
    per = g.separators(slots(spark, sf_dir)).groupBy("table_uid").agg(F.sort_array(F.collect_list("row_idx")).alias("rows"))
    return per.select("table_uid", index_ranges(F.col("rows")).alias("ranges"))
