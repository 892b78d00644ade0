"""Registered queries on layouts: rows set aside, headers in the middle, several subtables. They run over the derived
tables with merged cells planted among the data of the plain ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import evaluate, export, layouts, review, rules, scoring
from tablewright.operators import geometry as g
from tablewright.plans.fixtures import FIXTURE_CTES, bucketed, cells_of, parts, texts
from tablewright.plans.table_queries import COMMON, ORACLES, TYPES, query

#: Which of twelve lots a table is in, and what is planted: a title over all data columns but the first on row 3 of lot
#: 0, a cell over rows 1 and 2 of column 3 in lot 6. Both read plain tables of seven columns, whose ids are places.
LOT = "((CAST(substr(split_part(table_uid, '/t', 1), 4) AS BIGINT) - 1) * 20 + CAST(split_part(table_uid, '/t', 2) AS BIGINT)) % 12"
TITLE = "lot = 0 AND n_rows >= 6 AND row_idx = 3 AND col_idx >= 1"
TALL = "lot = 6 AND n_rows >= 3 AND row_idx IN (1, 2) AND col_idx = 3"
PLANT = f"""SELECT table_uid, row_idx, col_idx, CASE WHEN {TITLE} THEN 22 WHEN {TALL} THEN 10 ELSE cell_id END AS cell_id,
    CASE WHEN {TITLE} THEN 'Section' WHEN {TALL} THEN '12.5' ELSE text END AS text, lot, n_rows
FROM (SELECT *, {LOT} AS lot, max(row_idx) OVER (PARTITION BY table_uid) + 1 AS n_rows FROM SOURCE) x"""

_written: dict[tuple[str, str, str], str] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A derived table, written to the shared folder once in an application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        made, at = make(), f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
        bucketed(at, parts(spark), made)
        _written[key] = at
    return spark.table(_written[key])


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived places with their texts and merged cells planted."""
    return once(spark, sf_dir, "planted", lambda: spark.sql(PLANT.replace("SOURCE", "{source}"), source=texts(spark, sf_dir)).drop("lot", "n_rows"))


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir).drop("text")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "layouts", lambda: layouts.table_candidates(slots(spark, sf_dir)))


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "roles", lambda: layouts.roles(slots(spark, sf_dir), candidates(spark, sf_dir)))


#: The same in SQL: `found` are the boundaries without the rows set aside, lays the layouts in order, held their places.
_SPLIT = "slots AS (SELECT table_uid, row_idx, col_idx, cell_id FROM named)"
PLANTED = "WITH " + FIXTURE_CTES.replace("named AS (", "named0 AS (").replace(
    _SPLIT, f"named AS ({PLANT.replace('SOURCE', 'named0')}),\n{_SPLIT}"
)
LAYOUTS = PLANTED.replace(_SPLIT, """whole AS (SELECT table_uid, row_idx, col_idx, cell_id FROM named),
aside0 AS (SELECT table_uid, row_idx FROM whole GROUP BY ALL HAVING count(DISTINCT cell_id) = 1 AND count(*) > 1),
slots AS (SELECT table_uid, (dense_rank() OVER (PARTITION BY table_uid ORDER BY row_idx) - 1)::INTEGER AS row_idx, col_idx, cell_id, row_idx AS source_row FROM whole w WHERE NOT EXISTS (SELECT 1 FROM aside0 a WHERE a.table_uid = w.table_uid AND a.row_idx = w.row_idx))""") + COMMON + """,
planted_kinds AS (SELECT table_uid, any_value(n_rows) AS n_rows, any_value(CASE WHEN lot = 0 AND n_rows >= 6 THEN 'title' WHEN lot = 6 AND n_rows >= 3 THEN 'tall' WHEN lot IN (5, 11) AND n_rows >= 6 THEN 'band' ELSE 'other' END) AS kind FROM named GROUP BY 1),
cuts AS (SELECT 'band' AS kind, 'h' AS cut, 2 AS n UNION ALL SELECT 'title', 'h', 2 UNION ALL SELECT 'tall', 'v', 1 UNION ALL SELECT 'tall', 'v', 2),
lays0 AS (
    SELECT f.table_uid, k.kind, hmd, vmd, cut, CASE k.kind WHEN 'band' THEN (k.n_rows - 4) // 2 + 2 ELSE 3 END AS begins, n, 0 AS marginal
    FROM found f JOIN planted_kinds k ON k.table_uid = f.table_uid JOIN cuts c ON c.kind = k.kind WHERE NOT (k.kind = 'title' AND vmd = 1)
    UNION ALL SELECT f.table_uid, kind, hmd, vmd, '-', 0, 0, 1 FROM found f JOIN planted_kinds k ON k.table_uid = f.table_uid),
lays1 AS (SELECT *, (row_number() OVER (PARTITION BY table_uid ORDER BY marginal, hmd, vmd, n) - 1)::INTEGER AS ord,
    cut <> '-' OR table_uid IN (SELECT table_uid FROM aside0) OR (kind = 'title' AND vmd = 1) AS is_layout FROM lays0),
lays AS MATERIALIZED (SELECT *, CASE WHEN is_layout THEN 'layout' || row_number() OVER (PARTITION BY table_uid, is_layout ORDER BY ord) ELSE 'h' || hmd || '_v' || vmd END AS candidate_id FROM lays1),
held AS MATERIALIZED (
    SELECT l.table_uid, candidate_id, ord, is_layout, w.row_idx, w.col_idx, w.cell_id,
           CASE WHEN s.row_idx IS NULL OR (kind = 'title' AND cut = '-' AND vmd = 1 AND w.row_idx = 3) THEN 'separator'
                WHEN s.row_idx < hmd OR (cut = 'h' AND w.row_idx BETWEEN begins AND begins + n - 1) THEN 'hmd'
                WHEN w.col_idx < vmd OR (cut = 'v' AND w.col_idx BETWEEN begins AND begins + n - 1) THEN 'vmd' ELSE 'data' END AS role,
           CASE WHEN (cut = 'h' AND w.row_idx >= begins) OR (cut = 'v' AND w.col_idx >= begins) THEN 1 ELSE 0 END AS part
    FROM lays l JOIN whole w ON w.table_uid = l.table_uid
    LEFT JOIN (SELECT DISTINCT table_uid, source_row, row_idx FROM slots) s ON s.table_uid = w.table_uid AND s.source_row = w.row_idx),
parts AS MATERIALIZED (
    SELECT table_uid, candidate_id, any_value(ord) AS ord, any_value(is_layout) AS is_layout, part AS k, list_sort(list(DISTINCT row_idx)) AS rows_, list_sort(list(DISTINCT col_idx)) AS cols_,
           count(DISTINCT row_idx) FILTER (role = 'hmd') AS h, count(DISTINCT col_idx) FILTER (role = 'vmd') AS v
    FROM held WHERE role <> 'separator' GROUP BY table_uid, candidate_id, part)"""


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = LAYOUTS + sql


def listed(column) -> F.Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


@query()
def g12_layout_labels(spark, sf_dir):
    found = candidates(spark, sf_dir)
    drawn = layouts.layout_labels(slots(spark, sf_dir), found).join(found.select("table_uid", "candidate_id", "ord"), ["table_uid", "candidate_id"])
    return drawn.select("table_uid", "candidate_id", "ord", F.array_join("labels", "/").alias("labels"))


oracle("g12_layout_labels", " SELECT table_uid, candidate_id, ord, string_agg(drawn, '/' ORDER BY row_idx) AS labels FROM (SELECT table_uid, candidate_id, ord, row_idx, string_agg(role[1:1], '' ORDER BY col_idx) AS drawn FROM held GROUP BY ALL) GROUP BY ALL")


@query()
def g13_layouts(spark, sf_dir):
    """Candidates that are no plain boundaries, with the rows that they set aside and over how many columns."""
    found = candidates(spark, sf_dir).where("kind = 'layout'")
    shown = F.array_join(F.transform("separators", lambda s: F.concat_ws(":", s["row_idx"].cast("string"), F.size(s["columns"]).cast("string"))), ",")
    return found.select("table_uid", "candidate_id", "hmd", "vmd", shown.alias("separators"))


oracle("g13_layouts", " SELECT l.table_uid, l.candidate_id, hmd, vmd, coalesce(string_agg(row_idx || ':7', ',' ORDER BY row_idx), '') AS separators FROM lays l LEFT JOIN (SELECT DISTINCT table_uid, candidate_id, row_idx FROM held WHERE role = 'separator') h ON h.table_uid = l.table_uid AND h.candidate_id = l.candidate_id WHERE is_layout GROUP BY ALL")


@query()
def g16_subtables(spark, sf_dir):
    parts = candidates(spark, sf_dir).select("table_uid", "candidate_id", F.posexplode("subtables").alias("k", "s"))
    return parts.select("table_uid", "candidate_id", "k", listed("s.rows").alias("rows"), listed("s.columns").alias("columns"), "s.hmd", "s.vmd")


oracle("g16_subtables", " SELECT table_uid, candidate_id, k, array_to_string(rows_, ',') AS rows, array_to_string(cols_, ',') AS columns, h::INTEGER AS hmd, v::INTEGER AS vmd FROM parts")


def faulty(found: DataFrame) -> DataFrame:
    """Layouts with faults by the length of the first subtable: its last column left out, itself twice, its last row in a
    second subtable without headers, its last row set aside as well; none in every fifth."""
    s = F.col("subtables")[0]
    part = lambda rows, columns, h, v: F.struct(rows.alias("rows"), columns.alias("columns"), h.alias("hmd"), v.alias("vmd"))
    without = lambda c: F.slice(c, F.lit(1), F.size(c) - 1)
    lot, rest = F.size(s["rows"]) % 5, F.slice("subtables", F.lit(2), F.greatest(F.size("subtables") - 1, F.lit(0)))
    last = F.slice(s["rows"], -1, 1)
    narrow = part(s["rows"], without(s["columns"]), s["hmd"], s["vmd"])
    split = F.array(part(without(s["rows"]), s["columns"], s["hmd"], s["vmd"]), part(last, s["columns"], F.lit(0), F.lit(0)))
    subtables = F.when(lot == 0, F.concat(F.array(narrow), rest)).when(lot == 1, F.concat("subtables", F.array(s))).when(lot == 2, F.concat(split, rest)).otherwise(F.col("subtables"))
    aside = F.when(lot == 3, F.concat("separators", F.transform(last, lambda r: F.struct(r.alias("row_idx"), s["columns"].alias("columns"))))).otherwise(F.col("separators"))
    return found.withColumn("subtables", subtables).withColumn("separators", aside)


@query()
def g20_partition_checks(spark, sf_dir):
    return layouts.partition_checks(slots(spark, sf_dir), faulty(candidates(spark, sf_dir)))


oracle("g20_partition_checks", """, first_ AS (SELECT *, len(rows_) % 5 AS lot, rows_[-1] AS last_row, cols_[-1] AS last_col FROM parts WHERE k = 0),
places AS (SELECT h.*, f.lot, f.h, f.v, list_contains(f.rows_, h.row_idx) AND list_contains(f.cols_, h.col_idx) AND role <> 'separator' AS mine, h.row_idx = last_row AS at_last_row, h.col_idx = last_col AS at_last_col,
    h.row_idx = last_row AND lot = 2 AND list_contains(f.cols_, h.col_idx) AS moved FROM held h JOIN first_ f ON f.table_uid = h.table_uid AND f.candidate_id = h.candidate_id),
rows0 AS (SELECT table_uid, candidate_id, row_idx, col_idx, cell_id, CASE WHEN role = 'separator' THEN -1 WHEN moved AND mine THEN 100 ELSE part END AS k, CASE WHEN moved AND mine THEN 'data' ELSE role END AS role FROM places WHERE NOT (lot = 0 AND mine AND at_last_col)
    UNION ALL SELECT table_uid, candidate_id, row_idx, col_idx, cell_id, 100, role FROM places WHERE lot = 1 AND mine
    UNION ALL SELECT table_uid, candidate_id, row_idx, col_idx, cell_id, -1, 'separator' FROM places WHERE lot = 3 AND mine AND at_last_row),
every AS (SELECT h.table_uid, h.candidate_id, h.row_idx, h.col_idx, h.cell_id, r.k, r.role FROM held h LEFT JOIN rows0 r ON r.table_uid = h.table_uid AND r.candidate_id = h.candidate_id AND r.row_idx = h.row_idx AND r.col_idx = h.col_idx),
p AS (SELECT table_uid, candidate_id, row_idx, col_idx, count(role) AS n, count(*) FILTER (role = 'separator') AS aside, count(DISTINCT role) AS roles, count(*) FILTER (role = 'data') AS data FROM every GROUP BY ALL),
c AS (SELECT table_uid, candidate_id, cell_id, count(DISTINCT role) AS roles, count(DISTINCT k) FILTER (role = 'data') AS homes FROM every GROUP BY ALL),
c2 AS (SELECT table_uid, candidate_id, count(*) FILTER (roles > 1) AS several_roles, count(*) FILTER (homes > 1) AS split_data FROM c GROUP BY ALL)
SELECT p.table_uid, p.candidate_id, count(*) FILTER (n = 0) AS uncovered, count(*) FILTER (aside > 0 AND n > 1) AS overlapping, count(*) FILTER (roles > 1 AND aside = 0) AS disagreeing, count(*) FILTER (data > 0 AND n > 1 AND aside = 0) AS shared, any_value(several_roles) AS several_roles, any_value(split_data) AS split_data
FROM p JOIN c2 ON c2.table_uid = p.table_uid AND c2.candidate_id = p.candidate_id GROUP BY p.table_uid, p.candidate_id""")


@query()
def g22_complexity(spark, sf_dir):
    return layouts.complexity(candidates(spark, sf_dir))


oracle("g22_complexity", """, grade AS (SELECT p.table_uid, p.candidate_id, CASE WHEN count(*) > 1 THEN 3 WHEN bool_or(EXISTS (SELECT 1 FROM held h WHERE h.table_uid = p.table_uid AND h.candidate_id = p.candidate_id AND role = 'separator')) THEN 2 WHEN max(greatest(h, v)) > 1 THEN 1 ELSE 0 END AS grade FROM parts p GROUP BY 1, 2)
SELECT table_uid, CASE max(grade) WHEN 3 THEN 'subtables' WHEN 2 THEN 'separator_rows' WHEN 1 THEN 'multi_level' ELSE 'simple' END AS class FROM grade GROUP BY 1""")


@query()
def r1_reviewable_counts(spark, sf_dir):
    return review.reviewable_counts(candidates(spark, sf_dir))


oracle("r1_reviewable_counts", " SELECT table_uid, candidate_id, CASE WHEN any_value(h) = 0 THEN 0 ELSE any_value(rows_[h]) + 1 END::INTEGER AS hmd, any_value(v)::INTEGER AS vmd FROM parts GROUP BY ALL HAVING count(*) = 1")

SEGMENTS = """, seg AS (SELECT table_uid, candidate_id, any_value(is_layout) AS is_layout, string_agg(rows_[1] || '-' || rows_[-1] || ' ' || cols_[1] || '-' || cols_[-1] || ' ' || h || ' ' || v, '; ' ORDER BY cols_[1], rows_[1]) AS subtables FROM parts GROUP BY ALL),
segs AS (SELECT s.*, coalesce((SELECT string_agg(DISTINCT row_idx::VARCHAR, ',' ORDER BY row_idx) FROM (SELECT DISTINCT row_idx FROM held h WHERE h.table_uid = s.table_uid AND h.candidate_id = s.candidate_id AND role = 'separator')), '') AS separators FROM seg s)"""


@query()
def r9_segmentations(spark, sf_dir):
    found = review.segmentations(candidates(spark, sf_dir), g.shape(slots(spark, sf_dir)))
    show = lambda s: F.format_string("%d-%d %d-%d %d %d", s["first_row"], s["last_row"], s["first_col"], s["last_col"], s["head_rows"], s["side_cols"])
    return found.select("table_uid", "candidate_id", listed("segmentation.separator_rows").alias("separators"), F.array_join(F.transform("segmentation.subtables", show), "; ").alias("subtables"))


oracle("r9_segmentations", SEGMENTS.replace("string_agg(DISTINCT row_idx::VARCHAR, ',' ORDER BY row_idx)", "string_agg(row_idx::VARCHAR, ',' ORDER BY row_idx)") + " SELECT table_uid, candidate_id, separators, subtables FROM segs")


@query()
def r11_segmentation_verdicts(spark, sf_dir):
    """Answers with one header row and one header column below the rows set aside, for tables whose first layout of one
    subtable has such rows."""
    all_, found = slots(spark, sf_dir), candidates(spark, sf_dir)
    known = review.segmentations(found, g.shape(all_))
    first = found.where("kind = 'layout' AND size(subtables) = 1").groupBy("table_uid").agg(F.min_by(F.struct("candidate_id", "kind", "separators", "subtables"), "ord").alias("c")).select("table_uid", "c.*").withColumn("hmd", F.lit(1)).withColumn("vmd", F.lit(1))
    asked = first.withColumn("subtables", F.transform("subtables", lambda s: F.struct(s["rows"].alias("rows"), s["columns"].alias("columns"), F.lit(1).alias("hmd"), F.lit(1).alias("vmd"))))
    return review.segmentation_verdicts(review.segmentations(asked, g.shape(all_)).drop("candidate_id"), known)


oracle("r11_segmentation_verdicts", " SELECT d.table_uid, CASE WHEN l.candidate_id IS NULL THEN 'unparseable' ELSE 'valid' END AS final_status, l.candidate_id FROM (SELECT DISTINCT table_uid FROM lays WHERE is_layout AND cut = '-') d LEFT JOIN lays l ON l.table_uid = d.table_uid AND l.cut = '-' AND is_layout AND hmd = 1 AND vmd = 1")


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "planted-types", lambda: rules.type_cells(rules.SCIENCE, cells_of(planted(spark, sf_dir)).select("table_uid", "cell_id", "text")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "planted-lines", lambda: layouts.subtable_lines(held(spark, sf_dir)))


LINES = """, region AS (SELECT table_uid, candidate_id, cell_id, arg_min(role, (row_idx, col_idx)) AS region FROM held GROUP BY ALL),
lines_ AS (
    SELECT DISTINCT h.table_uid, h.candidate_id, part AS k, axis.axis, CASE axis.axis WHEN 'col' THEN col_idx WHEN 'row' THEN row_idx ELSE 0 END AS line, h.cell_id
    FROM held h JOIN region r ON r.table_uid = h.table_uid AND r.candidate_id = h.candidate_id AND r.cell_id = h.cell_id AND region = role
    JOIN (VALUES ('col', 'data'), ('row', 'data'), ('hmd', 'hmd'), ('vmd', 'vmd')) axis(axis, role) ON axis.role = h.role)"""


@query()
def c1_subtable_lines(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("table_uid", "candidate_id", "axis", F.col("line.k").alias("k"), F.col("line.at").alias("line")).agg(F.count("*").alias("n_cells"), F.sum("cell_id").alias("ids"))


oracle("c1_subtable_lines", LINES + " SELECT table_uid, candidate_id, axis, k, line, count(*) AS n_cells, sum(cell_id)::BIGINT AS ids FROM lines_ GROUP BY ALL")

COSTS = TYPES + LINES + """, counts_ AS (SELECT l.table_uid, candidate_id, k AS sub, axis, line, family AS kind, count(*) AS k, sum(count(*)) OVER (PARTITION BY l.table_uid, candidate_id, k, axis, line) AS n
    FROM lines_ l JOIN types t ON t.table_uid = l.table_uid AND t.cell_id = l.cell_id WHERE family NOT IN ('empty', 'untyped', 'Missing') AND NOT (axis = 'row' AND type = 'Word') GROUP BY l.table_uid, candidate_id, l.k, axis, line, family),
typed_ AS (SELECT table_uid, count(*) AS n_typed FROM types WHERE family NOT IN ('empty', 'untyped', 'Missing') GROUP BY 1),
bits_ AS (SELECT c.table_uid, candidate_id, axis, sum(-k * log2(k / n)) + 0.5 * log2(greatest(any_value(n_typed), 2)) AS bits FROM counts_ c JOIN typed_ t ON t.table_uid = c.table_uid GROUP BY c.table_uid, candidate_id, sub, axis, line),
extra AS (SELECT l.table_uid, candidate_id, count(DISTINCT (l.k, l.cell_id)) * 0.5 * log2(greatest(any_value(n_typed), 2)) AS extra FROM lines_ l JOIN types t ON t.table_uid = l.table_uid AND t.cell_id = l.cell_id JOIN typed_ y ON y.table_uid = l.table_uid WHERE axis = 'vmd' AND type = 'Word' GROUP BY ALL),
costs AS (SELECT b.table_uid, b.candidate_id, sum(CASE WHEN axis IN ('col', 'row') THEN bits / 2 ELSE bits END) + coalesce(any_value(extra), 0) AS bits FROM bits_ b LEFT JOIN extra e ON e.table_uid = b.table_uid AND e.candidate_id = b.candidate_id GROUP BY b.table_uid, b.candidate_id)"""


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.bit_costs(lines(spark, sf_dir), types(spark, sf_dir), roles=("Word",))


@query()
def c4_layout_costs(spark, sf_dir):
    """Costs of all layouts, by subtables, with words as the role of row names."""
    return costs(spark, sf_dir).withColumn("bits", F.round("bits", 6))


oracle("c4_layout_costs", COSTS + " SELECT table_uid, candidate_id, round(bits, 6) AS bits FROM costs")


@query()
def c8_layout_selection(spark, sf_dir):
    """The cheapest layout; among ties fewer steps from (1, 1), then fewer subtables, then the id."""
    found = candidates(spark, sf_dir).withColumn("n_subtables", F.size("subtables"))
    chosen = scoring.select(costs(spark, sf_dir).withColumnRenamed("bits", "score"), found)
    return chosen.select("table_uid", "selected_candidate_id", "selected_by", "n_tied", F.round("gap", 6).alias("gap"))


oracle("c8_layout_selection", COSTS + """, keyed AS (SELECT c.table_uid, c.candidate_id, bits, abs(hmd - 1) + abs(vmd - 1) AS steps, CASE cut WHEN '-' THEN 1 ELSE 2 END AS n_sub, min(bits) OVER (PARTITION BY c.table_uid) AS least, count(*) OVER (PARTITION BY c.table_uid) AS n, row_number() OVER (PARTITION BY c.table_uid ORDER BY bits, c.candidate_id) AS place FROM costs c JOIN lays l ON l.table_uid = c.table_uid AND l.candidate_id = c.candidate_id)
SELECT table_uid, arg_min(candidate_id, (bits - least > 1e-9, steps, n_sub, candidate_id)) AS selected_candidate_id, CASE WHEN any_value(n) = 1 THEN 'only_candidate' WHEN count(*) FILTER (bits - least <= 1e-9) > 1 THEN 'tie_break' ELSE 'score' END AS selected_by, count(*) FILTER (bits - least <= 1e-9) AS n_tied, round(CASE WHEN any_value(n) > 1 THEN min(bits) FILTER (place = 2) - min(bits) END, 6) AS gap FROM keyed GROUP BY table_uid""")


@query()
def e5_subtable_headers(spark, sf_dir):
    """Header cells of every subtable as a table of its own, by axis, the corner's too, with the cell over each."""
    views, chosen = layouts.as_tables(slots(spark, sf_dir), candidates(spark, sf_dir))
    turned = chosen.select("table_uid", F.col("vmd").alias("hmd"), F.col("hmd").alias("vmd"))
    axes = [("hmd", export.header_nodes(views, chosen)), ("vmd", export.header_nodes(export.transposed(views), turned)), ("corner", export.corner_nodes(views, chosen))]
    named = [d.select("table_uid", F.lit(n).alias("axis"), "cell_id", "first_col", "last_col", "parent_id", "n_parents") for n, d in axes]
    return named[0].unionByName(named[1]).unionByName(named[2])


oracle("e5_subtable_headers", """, spots AS MATERIALIZED (SELECT h.table_uid || '#' || h.candidate_id || '#' || k AS uid, list_position(rows_, row_idx) - 1 AS r, list_position(cols_, col_idx) - 1 AS c, cell_id, p.h, p.v FROM held h JOIN parts p ON p.table_uid = h.table_uid AND p.candidate_id = h.candidate_id AND p.k = h.part WHERE role <> 'separator'),
turned AS (SELECT uid, 'hmd' AS axis, r, c, cell_id FROM spots WHERE r < h AND c >= v UNION ALL SELECT uid, 'vmd', c, r, cell_id FROM spots WHERE c < v AND r >= h UNION ALL SELECT uid, 'corner', r, c, cell_id FROM spots WHERE r < h AND c < v),
nodes AS (SELECT uid, axis, cell_id, min(r) AS top, min(c) AS first_col, max(c) AS last_col FROM turned GROUP BY ALL),
over_ AS (SELECT n.uid, n.axis, n.cell_id, min(t.cell_id) AS parent_id, count(DISTINCT t.cell_id) AS n_parents FROM nodes n JOIN turned t ON t.uid = n.uid AND t.axis = n.axis AND t.r = n.top - 1 AND t.c BETWEEN first_col AND last_col GROUP BY ALL)
SELECT n.uid AS table_uid, n.axis, n.cell_id, first_col::INTEGER AS first_col, last_col::INTEGER AS last_col, parent_id, coalesce(n_parents, 0) AS n_parents FROM nodes n LEFT JOIN over_ o ON o.uid = n.uid AND o.axis = n.axis AND o.cell_id = n.cell_id""")


@query()
def e5_layout_separators(spark, sf_dir):
    return export.layout_separator_texts(held(spark, sf_dir), cells_of(planted(spark, sf_dir)))


oracle("e5_layout_separators", " SELECT table_uid, candidate_id, row_idx, string_agg(text, ' | ' ORDER BY first_) AS text FROM (SELECT h.table_uid, h.candidate_id, h.row_idx, min(h.col_idx) AS first_, max(text) AS text FROM held h JOIN named n ON n.table_uid = h.table_uid AND n.row_idx = h.row_idx AND n.col_idx = h.col_idx WHERE role = 'separator' GROUP BY h.table_uid, h.candidate_id, h.row_idx, h.cell_id) GROUP BY ALL")


@query()
def r4_parse_descriptions(spark, sf_dir):
    return review.parse_descriptions(candidates(spark, sf_dir))


RANGES = "(SELECT string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) FROM (SELECT min(x) AS a, max(x) AS b FROM (SELECT x, x - row_number() OVER (ORDER BY x) AS island FROM (SELECT unnest(LISTED) AS x)) GROUP BY island))"
oracle("r4_parse_descriptions", f""", said AS (SELECT table_uid, candidate_id, k, any_value(is_layout) AS is_layout, any_value(h) AS h, any_value(v) AS v, {RANGES.replace('LISTED', 'any_value(rows_)')} AS r, {RANGES.replace('LISTED', 'any_value(cols_)')} AS c FROM parts GROUP BY ALL),
aside_ AS (SELECT table_uid, candidate_id, list(DISTINCT row_idx ORDER BY row_idx) AS rs FROM held WHERE role = 'separator' GROUP BY ALL),
ranged AS (SELECT table_uid, candidate_id, {RANGES.replace('LISTED', 'rs')} AS ranges FROM aside_),
joined_ AS (SELECT table_uid, candidate_id, any_value(is_layout) AS is_layout, any_value(h) AS h, any_value(v) AS v, string_agg('a subtable of rows ' || r || ' and columns ' || c || ' with H = ' || h || ', V = ' || v, '; ' ORDER BY k) AS body FROM said GROUP BY ALL)
SELECT j.table_uid, j.candidate_id, CASE WHEN NOT is_layout THEN 'H = ' || h || ', V = ' || v || '.' WHEN ranges IS NULL THEN body || '.' ELSE body || '; rows ' || ranges || ' are set aside as separators.' END AS description FROM joined_ j LEFT JOIN ranged r ON r.table_uid = j.table_uid AND r.candidate_id = j.candidate_id""")


def first_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first layout of each table as its gold labels: the one with most cuts."""
    first = candidates(spark, sf_dir).where("ord = 0").select("table_uid", "candidate_id")
    return once(spark, sf_dir, "gold-regions", lambda: layouts.cell_labels(held(spark, sf_dir).join(first, ["table_uid", "candidate_id"], "left_semi")))


@query()
def a8_gold_against_others(spark, sf_dir):
    """The purity of gold labels against that of all other plain boundaries, column by column and row by row."""
    gold, kinds = first_regions(spark, sf_dir), types(spark, sf_dir)
    others = evaluate.boundary_purities(slots(spark, sf_dir), kinds, gold)
    found = evaluate.purity_comparison(evaluate.region_purities(slots(spark, sf_dir), gold, kinds), others)
    return found.select("axis", "tables", *[F.round(c, 6).alias(c) for c in ("gold_purity", "other_purity", "gold_purest", "gold_tied")])


oracle("a8_gold_against_others", TYPES + """, gold AS (SELECT table_uid, cell_id, arg_min(role, (row_idx, col_idx)) AS region FROM held WHERE ord = 0 GROUP BY ALL),
box AS (SELECT w.table_uid, w.cell_id, min(row_idx) AS r0, max(row_idx) AS r1, min(col_idx) AS c0, max(col_idx) AS c1 FROM whole w WHERE table_uid IN (SELECT table_uid FROM gold) GROUP BY ALL),
high AS (SELECT table_uid, max(r1) AS last_r, max(c1) AS last_c FROM box GROUP BY 1),
tried AS (SELECT t.table_uid, h.h, v.v FROM high t, range(0, 5) h(h), range(0, 4) v(v) WHERE h.h <= last_r AND v.v <= last_c AND h.h + v.v > 0),
named_ AS MATERIALIZED (SELECT t.table_uid, t.h, t.v, b.cell_id, CASE WHEN r0 < t.h THEN 'hmd' WHEN c0 < t.v THEN 'vmd' ELSE 'data' END AS region, (r0 < t.h AND r1 >= t.h) OR (r0 >= t.h AND c0 < t.v AND c1 >= t.v) AS is_cut FROM tried t JOIN box b ON b.table_uid = t.table_uid),
other AS (SELECT n.table_uid, h, v FROM named_ n JOIN gold g ON g.table_uid = n.table_uid AND g.cell_id = n.cell_id GROUP BY ALL HAVING NOT bool_or(is_cut) AND bool_or(n.region <> g.region)),
spots AS MATERIALIZED (SELECT DISTINCT w.table_uid, axis, CASE axis WHEN 'col' THEN col_idx ELSE row_idx END AS line, w.cell_id, family FROM whole w JOIN types t ON t.table_uid = w.table_uid AND t.cell_id = w.cell_id, (VALUES ('col'), ('row')) a(axis) WHERE family NOT IN ('empty', 'untyped', 'Missing')),
all_ AS (SELECT n.table_uid, h AS h, v AS v, cell_id FROM named_ n JOIN other o USING (table_uid, h, v) WHERE region = 'data' UNION ALL SELECT table_uid, -1, -1, cell_id FROM gold WHERE region = 'data'),
counted AS (SELECT a.table_uid, h, v, axis, line, family, count(*) AS k FROM all_ a JOIN spots s ON s.table_uid = a.table_uid AND s.cell_id = a.cell_id GROUP BY ALL),
pure AS (SELECT table_uid, h, v, axis, avg(p) AS purity FROM (SELECT table_uid, h, v, axis, line, max(k) / sum(k) AS p FROM counted GROUP BY ALL) GROUP BY ALL),
rest AS (SELECT table_uid, axis, avg(purity) AS mean_, max(purity) AS best FROM pure WHERE h >= 0 GROUP BY ALL)
SELECT p.axis, count(*) AS tables, round(avg(purity), 6) AS gold_purity, round(avg(mean_), 6) AS other_purity, round(avg((round(purity, 12) > round(best, 12))::INTEGER), 6) AS gold_purest, round(avg((round(purity, 12) = round(best, 12))::INTEGER), 6) AS gold_tied FROM pure p JOIN rest r ON r.table_uid = p.table_uid AND r.axis = p.axis WHERE h = -1 GROUP BY 1""")
