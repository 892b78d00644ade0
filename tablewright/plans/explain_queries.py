"""Registered queries on explanations: witnesses of broken rules, messages and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import explain, repair, review
from tablewright.operators.geometry import RULE_ORDER
from tablewright.plans import layout_queries as lq
from tablewright.plans import repair_queries as rq
from tablewright.plans.fixtures import cells_of
from tablewright.plans.table_queries import ORACLES, grid_targets, query


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries from (0, 0) to (3, 2) of every table, and one outside all."""
    grid = grid_targets(lq.slots(spark, sf_dir))
    return grid.unionByName(grid.where("hmd = 0 AND vmd = 0").withColumn("hmd", F.lit(99)))


def named_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lq.candidates(spark, sf_dir)
    return review.reviewable_counts(found).join(found.select("table_uid", "candidate_id", "ord"), ["table_uid", "candidate_id"])


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lq.once(spark, sf_dir, "explained", lambda: explain.explain(lq.slots(spark, sf_dir), cells_of(lq.planted(spark, sf_dir)), targets(spark, sf_dir), named_counts(spark, sf_dir)))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def said(rule: int, *args: str) -> str:
    return f"printf({', '.join([quoted(explain.MESSAGES[rule]), *args])})"


def spoken(values: str, one: str, many: str) -> str:
    return f"CASE WHEN len({values}) = 1 THEN '{one} ' || {values}[1] ELSE '{many} ' || array_to_string({values}[1:-2], ', ') || ' and ' || {values}[-1] END"


CATEGORY = " ".join(f"WHEN {n} THEN '{c}'" for n, c in explain.CATEGORIES.items())
PLACE = " ".join(f"WHEN {n} THEN {k}" for k, n in enumerate(RULE_ORDER))
#: The tables have no empty cells, so that rules 2 and 3 name none.
BROKEN = lq.LAYOUTS + f""",
offered AS (SELECT table_uid, candidate_id, any_value(ord) AS ord, (CASE WHEN any_value(h) = 0 THEN 0 ELSE any_value(rows_[h]) + 1 END)::INTEGER AS hmd, any_value(v)::INTEGER AS vmd FROM parts GROUP BY table_uid, candidate_id HAVING count(*) = 1),
heights AS (SELECT table_uid, max(row_idx) + 1 AS height FROM whole GROUP BY 1),
tg0 AS (SELECT table_uid, height, h.h::INTEGER AS hmd, v.v::INTEGER AS vmd FROM heights, range(0, 4) h(h), range(0, 3) v(v) UNION ALL SELECT table_uid, height, 99, 0 FROM heights),
keeps AS (SELECT DISTINCT table_uid, source_row, row_idx FROM slots),
tg AS MATERIALIZED (SELECT t.*, t.hmd <= height AS inside, (SELECT count(*) FROM keeps k WHERE k.table_uid = t.table_uid AND source_row < t.hmd)::INTEGER AS kept, (SELECT coalesce(max(source_row) + 1, 0) FROM keeps k WHERE k.table_uid = t.table_uid AND source_row < t.hmd)::INTEGER AS read_hmd, o.candidate_id AS offered
    FROM tg0 t LEFT JOIN offered o ON o.table_uid = t.table_uid AND o.hmd = t.hmd AND o.vmd = t.vmd),
opened AS MATERIALIZED (SELECT t.*, d.n_rows, d.n_cols FROM tg t JOIN dims d ON d.table_uid = t.table_uid WHERE inside AND offered IS NULL),
near AS MATERIALIZED (SELECT o.hmd, o.vmd, o.kept, s.* FROM opened o JOIN adj s ON s.table_uid = o.table_uid),
hits AS (
    SELECT table_uid, hmd, vmd, 0 AS rule, cell_id AS x FROM near WHERE row_idx >= kept AND col_idx = vmd - 1 AND cell_id = right_id
    UNION SELECT table_uid, hmd, vmd, 1, cell_id FROM near WHERE row_idx = kept - 1 AND cell_id = below_id
    UNION SELECT table_uid, hmd, vmd, 4, below_id FROM near WHERE row_idx < kept - 1 AND col_idx >= vmd AND cell_id <> right_id AND below_id = diagonal_id
    UNION SELECT table_uid, hmd, vmd, 5, right_id FROM near WHERE col_idx < vmd - 1 AND row_idx >= kept - 1 AND cell_id <> below_id AND right_id = diagonal_id
    UNION SELECT table_uid, hmd, vmd, 6, cell_id FROM near WHERE row_idx = kept - 1 AND col_idx >= vmd - 1 AND cell_id = right_id
    UNION SELECT table_uid, hmd, vmd, 9, cell_id FROM near WHERE kept = 0 GROUP BY ALL HAVING count(*) > 1
    UNION SELECT table_uid, hmd, vmd, 2, (SELECT source_row FROM keeps k WHERE k.table_uid = n.table_uid AND k.row_idx = n.row_idx) FROM near n WHERE row_idx < kept - 1 GROUP BY ALL HAVING NOT coalesce(bool_or(col_idx >= vmd AND cell_id = right_id AND below_id <> diagonal_id), false)
    UNION SELECT table_uid, hmd, vmd, 3, col_idx FROM near WHERE col_idx < vmd - 1 GROUP BY table_uid, hmd, vmd, col_idx HAVING NOT coalesce(bool_or(row_idx >= kept AND cell_id = below_id AND right_id <> diagonal_id), false)
    UNION SELECT table_uid, hmd, vmd, 7, NULL FROM opened WHERE kept = 0 AND vmd = 0
    UNION SELECT table_uid, hmd, vmd, 8, NULL FROM opened WHERE kept >= n_rows OR vmd >= n_cols),
broke AS MATERIALIZED (SELECT table_uid, hmd, vmd, rule, CASE rule {PLACE} END AS at_, coalesce(list(x ORDER BY x) FILTER (x IS NOT NULL), []) AS xs FROM hits GROUP BY ALL),
phrases AS (
    SELECT b.table_uid, hmd, vmd, rule, count(*) AS n, list('cell ' || x || ' "' || CASE WHEN length(text) > 30 THEN text[1:30] || '...' ELSE text END || '" (' || CASE WHEN row_idx = last_row THEN 'row ' || row_idx ELSE 'rows ' || row_idx || '-' || last_row END || ', ' || CASE WHEN col_idx = last_col THEN 'column ' || col_idx ELSE 'columns ' || col_idx || '-' || last_col END || ')' ORDER BY x) AS ps
    FROM (SELECT *, unnest(xs) AS x FROM broke WHERE rule NOT IN (2, 3, 7, 8)) b JOIN cells c ON c.table_uid = b.table_uid AND c.cell_id = b.x GROUP BY ALL),
listed AS (SELECT *, ps[1:3] || CASE WHEN n > 3 THEN [(n - 3) || ' more'] ELSE [] END AS shown FROM phrases),
told AS (SELECT *, CASE len(shown) WHEN 1 THEN shown[1] ELSE array_to_string(shown[1:-2], ', ') || ' and ' || shown[-1] END AS phrase, CASE n WHEN 1 THEN 'spans' ELSE 'span' END AS verb FROM listed),
messages AS MATERIALIZED (
    SELECT b.table_uid, b.hmd, b.vmd, b.rule, b.at_, b.xs, CASE b.rule WHEN 7 THEN {quoted(explain.ALL_DATA)}
        WHEN 8 THEN printf({quoted(explain.NO_DATA)}, CASE WHEN o.kept >= o.n_rows AND o.vmd >= o.n_cols THEN {quoted(explain.EVERY_BOTH)} WHEN o.kept >= o.n_rows THEN {quoted(explain.EVERY_ROW)} ELSE {quoted(explain.EVERY_COLUMN)} END)
        WHEN 9 THEN {said(9, 'phrase')} WHEN 0 THEN {said(0, 'b.vmd', 'phrase')} WHEN 1 THEN {said(1, 'o.read_hmd - 1', 'phrase')}
        WHEN 2 THEN {said(2, spoken('b.xs', 'row', 'rows'), f"CASE len(b.xs) WHEN 1 THEN '{explain.IT_HEADS}' ELSE '{explain.THEY_HEAD}' END", "''")}
        WHEN 3 THEN {said(3, spoken('b.xs', 'column', 'columns'), f"CASE len(b.xs) WHEN 1 THEN '{explain.IT_GROUPS}' ELSE '{explain.THEY_GROUP}' END", "''")}
        WHEN 4 THEN {said(4, 'phrase', 'verb')} WHEN 5 THEN {said(5, 'phrase', 'verb')} ELSE {said(6, 'o.read_hmd - 1', 'phrase', 'verb')} END AS message
    FROM broke b JOIN opened o ON o.table_uid = b.table_uid AND o.hmd = b.hmd AND o.vmd = b.vmd
    LEFT JOIN told t ON t.table_uid = b.table_uid AND t.hmd = b.hmd AND t.vmd = b.vmd AND t.rule = b.rule)"""


@query()
def r12_violations(spark, sf_dir):
    """Every rule that a boundary breaks, with the cells, rows and columns that show it."""
    each = explained(spark, sf_dir).select("table_uid", "hmd", "vmd", F.posexplode("violations").alias("place", "v")).where("v.rule IS NOT NULL")
    ids = lambda x: lq.listed(x)
    return each.select("table_uid", "hmd", "vmd", "place", "v.rule", "v.category", "v.count", ids(F.transform("v.cells", lambda c: c["cell_id"])).alias("cells"), ids("v.rows").alias("rows"), ids("v.columns").alias("columns"))


ORACLES["r12_violations"] = BROKEN + f""" SELECT table_uid, hmd, vmd, (row_number() OVER (PARTITION BY table_uid, hmd, vmd ORDER BY at_) - 1)::INTEGER AS place, rule, CASE rule {CATEGORY} END AS category,
    CASE WHEN rule IN (2, 3, 7, 8) THEN 0 ELSE len(xs) END::INTEGER AS count, CASE WHEN rule IN (2, 3, 7, 8) THEN '' ELSE array_to_string(xs[1:5], ',') END AS cells, CASE rule WHEN 2 THEN array_to_string(xs, ',') ELSE '' END AS rows, CASE rule WHEN 3 THEN array_to_string(xs, ',') ELSE '' END AS columns FROM messages"""
# a rule without witness cells has no list of them
ORACLES["r12_violations"] = ORACLES["r12_violations"].replace("THEN '' ELSE array_to_string(xs[1:5], ',') END AS cells", "THEN NULL ELSE array_to_string(xs[1:5], ',') END AS cells")


@query()
def r13_explanations(spark, sf_dir):
    found = explained(spark, sf_dir)
    return found.select("table_uid", "hmd", "vmd", "category", F.array_join("categories", ",").alias("categories"), "summary", "kept_hmd", lq.listed("set_aside").alias("set_aside"), F.array_join(F.transform("nearest", lambda c: c["candidate_id"]), ",").alias("nearest"))


ORACLES["r13_explanations"] = BROKEN + f""",
gathered AS (SELECT table_uid, hmd, vmd, string_agg(message, ' ' ORDER BY at_) AS body, list(CASE rule {CATEGORY} END ORDER BY at_) AS cats FROM messages GROUP BY ALL),
set_rows AS (SELECT table_uid, list(row_idx ORDER BY row_idx) AS rs FROM aside0 GROUP BY 1),
steps AS (SELECT t.table_uid, t.hmd, t.vmd, o.candidate_id, row_number() OVER (PARTITION BY t.table_uid, t.hmd, t.vmd ORDER BY abs(o.hmd - t.hmd) + abs(o.vmd - t.vmd), o.ord) AS k FROM tg t JOIN offered o ON o.table_uid = t.table_uid),
nearest AS (SELECT table_uid, hmd, vmd, string_agg(candidate_id, ',' ORDER BY k) AS nearest FROM steps WHERE k <= 3 GROUP BY ALL),
joined AS (SELECT t.*, g.body, g.cats, coalesce(rs, []) AS rs, list_filter(coalesce(rs, []), lambda r: r < t.hmd) AS inner_, range(t.read_hmd, t.hmd) AS span_, coalesce(n.nearest, '') AS nearest, o.candidate_id AS read_as
    FROM tg t LEFT JOIN gathered g ON g.table_uid = t.table_uid AND g.hmd = t.hmd AND g.vmd = t.vmd LEFT JOIN set_rows s ON s.table_uid = t.table_uid LEFT JOIN nearest n ON n.table_uid = t.table_uid AND n.hmd = t.hmd AND n.vmd = t.vmd
    LEFT JOIN offered o ON o.table_uid = t.table_uid AND o.hmd = t.read_hmd AND o.vmd = t.vmd),
named_ AS (SELECT *, CASE WHEN NOT inside THEN ['out_of_range'] WHEN offered IS NOT NULL THEN ['offered'] ELSE coalesce(cats, ['not_offered']) END AS categories FROM joined)
SELECT table_uid, hmd, vmd, categories[1] AS category, array_to_string(list_transform(list_filter(list_zip(categories, range(1, len(categories) + 1)), lambda p: list_position(categories, p[1]) = p[2]), lambda p: p[1]), ',') AS categories,
    CASE WHEN NOT inside THEN printf({quoted(explain.OUTSIDE)}, hmd, vmd, height, 7) WHEN offered IS NOT NULL THEN printf({quoted(explain.OFFERED)}, hmd, vmd, offered)
    ELSE printf({quoted(explain.NOT_OFFERED)}, hmd, vmd) || CASE WHEN len(inner_) = 0 THEN '' ELSE printf({quoted(explain.SET_ASIDE)}, {spoken('inner_', 'row', 'rows')}, kept) END
        || coalesce(body, CASE WHEN read_hmd <> hmd THEN printf({quoted(explain.ENDS_ASIDE)}, {spoken('span_', 'row', 'rows')}, read_hmd, vmd, CASE WHEN read_as IS NULL THEN '' ELSE printf({quoted(explain.WHICH_IS)}, read_as) END) ELSE {quoted(explain.NO_RULE)} END) END AS summary,
    CASE WHEN inside THEN kept END AS kept_hmd, CASE WHEN inside THEN array_to_string(rs, ',') ELSE '' END AS set_aside, nearest FROM named_"""


@query()
def r15_explained_counts(spark, sf_dir):
    """The targets of the tables with blanks, every seventh article's without a single boundary, with their repairs."""
    slots, cells, asked = rq.parts(spark, sf_dir)
    left_out = F.regexp_extract("table_uid", "PMC([0-9]+)/", 1).cast("long") % 7 == 0
    some = asked.withColumn("hmd", F.when(~left_out, F.col("hmd")))
    counts = repair.marginal_counts(slots).withColumn("candidate_id", F.format_string("h%d_v%d", "hmd", "vmd")).withColumn("ord", F.col("hmd") * 1000 + F.col("vmd"))
    return explain.explained_counts(explain.explain(slots, cells, some, counts), some, rq.mended(spark, sf_dir)[0])


ORACLES["r15_explained_counts"] = rq.EXPECTED + """, e AS (SELECT *, CASE kind WHEN 3 THEN 'offered' WHEN 4 THEN 'boundary_cuts_merged_cell' ELSE 'missing_hierarchy_evidence' END AS category,
    CASE kind WHEN 3 THEN NULL WHEN 4 THEN '0' WHEN 5 THEN '2' ELSE '3' END AS rule, CASE WHEN kind IN (0, 4, 5) THEN 'repaired' WHEN kind = 3 THEN 'already_offered' ELSE 'refused' END AS status FROM uids WHERE t % 7 <> 0)
SELECT 'explained' AS what, NULL::VARCHAR AS value, NULL::VARCHAR AS status, count(*) AS n FROM e UNION ALL SELECT 'excluded', NULL, NULL, count(*) FROM uids WHERE t % 7 = 0
UNION ALL SELECT 'category', category, NULL, count(*) FROM e GROUP BY ALL UNION ALL SELECT 'rule', rule, NULL, count(*) FROM e WHERE rule IS NOT NULL GROUP BY ALL UNION ALL SELECT 'repair', category, status, count(*) FROM e GROUP BY ALL"""
