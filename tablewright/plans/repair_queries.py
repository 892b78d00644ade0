"""Registered queries on repairs and explanations, over tables with blank cells: one for every order, in six kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import geometry as g
from tablewright.operators import repair
from tablewright.plans.layout_queries import once
from tablewright.plans.table_queries import ORACLES, query

#: Two to four groups (b) of two or three items (c). Kinds: 0 groups named once, over the same items; 1 over other items
#: each; 2 as 0, but the first group named on its second row; 3 all named; 4 as 3, under a row of one label over two
#: columns and a blank; 5 as 0, turned: groups in the first of two header rows. Targets: what a reviewer would answer.
BLANKED = """
shapes AS (SELECT CAST(o_orderkey AS BIGINT) AS t, CAST(o_orderkey % 6 AS INT) AS kind, CAST(2 + o_custkey % 3 AS INT) AS b, CAST(2 + o_custkey % 2 AS INT) AS c FROM orders),
wide AS (SELECT shapes.*, g.g, i.i FROM shapes JOIN (SELECT * FROM (VALUES (0), (1), (2), (3)) AS v(g)) g ON g.g < shapes.b JOIN (SELECT * FROM (VALUES (0), (1), (2)) AS v(i)) i ON i.i < shapes.c),
fields AS (SELECT * FROM (VALUES (0, 'Group'), (1, 'Item'), (2, 'Value')) AS v(col, title)),
lines AS (SELECT * FROM (VALUES (0), (1), (2), (3)) AS v(line)),
drawn AS (
    SELECT t, kind, 0 AS row_idx, col AS col_idx, col AS cell_id, title AS text FROM shapes JOIN fields ON kind < 5
    UNION ALL SELECT t, kind, g * c + i + 1, col, (g * c + i + 1) * 3 + col,
        CASE col WHEN 0 THEN CASE WHEN kind = 3 OR i = CASE WHEN kind = 2 AND g = 0 THEN 1 ELSE 0 END THEN 'G' || CAST(g AS STRING) ELSE ' ' END
                 WHEN 1 THEN CASE WHEN kind = 1 THEN 'x' || CAST(g AS STRING) ELSE 'x' END || CAST(i AS STRING) ELSE CAST(t % 100 + g AS STRING) END
    FROM wide JOIN fields ON kind < 4
    UNION ALL SELECT t, kind, 1, col, CASE WHEN col < 2 THEN 3 ELSE 4 END, CASE WHEN col < 2 THEN 'All' ELSE '' END FROM shapes JOIN fields ON kind = 4
    UNION ALL SELECT t, kind, g * c + i + 2, col, (g * c + i + 2) * 3 + col - 1, CASE col WHEN 0 THEN 'G' || CAST(g * c + i AS STRING) WHEN 1 THEN 'x' ELSE CAST(t % 100 AS STRING) END FROM wide JOIN fields ON kind = 4
    UNION ALL SELECT t, kind, line, 0, line * (b * c + 1), 'N' || CAST(line AS STRING) FROM shapes JOIN lines ON kind = 5
    UNION ALL SELECT t, kind, line, g * c + i + 1, line * (b * c + 1) + g * c + i + 1,
        CASE line WHEN 0 THEN CASE WHEN i = 0 THEN 'G' || CAST(g AS STRING) ELSE '' END WHEN 1 THEN 'x' || CAST(i AS STRING) ELSE CAST(t % 100 + g AS STRING) END FROM wide JOIN lines ON kind = 5),
blanked AS (SELECT 'PMC' || CAST(t AS STRING) || '/t0' AS table_uid, kind, CAST(row_idx AS INT) AS row_idx, CAST(col_idx AS INT) AS col_idx, CAST(cell_id AS INT) AS cell_id, text FROM drawn)"""


def blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
        return spark.sql(f"WITH {BLANKED.replace('FROM orders', 'FROM {orders}')} SELECT * FROM blanked", orders=orders)

    return once(spark, sf_dir, "blanked", make)


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Slots, cells and targets of the tables with blanks."""
    named = blanked(spark, sf_dir)
    h, v = F.when(F.col("kind") == 5, 2).otherwise(1), F.when(F.col("kind") < 3, 2).otherwise(1)
    return named.select("table_uid", "row_idx", "col_idx", "cell_id"), named.select("table_uid", "cell_id", "text").distinct(), named.select("table_uid", h.alias("hmd"), v.alias("vmd")).distinct()


def mended(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results, merges and refusals, computed once in an application."""
    found: list[DataFrame] = []

    def part(k: int):
        if not found:
            found.extend(repair.repairs(*parts(spark, sf_dir)))
        return found[k]

    return tuple(once(spark, sf_dir, f"repairs{k}", lambda k=k: part(k)) for k in range(3))


#: What each kind comes to: E the blanks that join A, in order.
EXPECTED = f"""WITH {BLANKED},
uids AS (SELECT 'PMC' || t || '/t0' AS table_uid, * FROM shapes),
merges AS (
    SELECT table_uid, (g * c + i + 1) * 3 AS cell_id, (g * c + 1) * 3 AS into_, 'up' AS direction, g * c + i + 1 AS r, 0 AS first_col, g * c + i AS pos FROM wide JOIN uids USING (t, kind, b, c) WHERE kind = 0 AND i > 0
    UNION ALL SELECT table_uid, 4, 3, 'left', 1, 2, 0 FROM uids WHERE kind = 4
    UNION ALL SELECT table_uid, g * c + i + 1, g * c + 1, 'left', 0, g * c + i + 1, g * c + i FROM wide JOIN uids USING (t, kind, b, c) WHERE kind = 5 AND i > 0)"""


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = EXPECTED + sql


@query()
def r17_merges(spark, sf_dir):
    """Blanks joined to labels in columns and header rows, on the evidence of repeated children, in order."""
    return mended(spark, sf_dir)[1].join(blanked(spark, sf_dir).where("kind <> 4").select("table_uid").distinct(), "table_uid", "left_semi")


oracle("r17_merges", ' SELECT table_uid, (row_number() OVER (PARTITION BY table_uid ORDER BY pos))::INTEGER AS n, cell_id::INTEGER AS cell_id, into_::INTEGER AS "into", direction, r::INTEGER AS first_row, r::INTEGER AS last_row, first_col::INTEGER AS first_col, first_col::INTEGER AS last_col FROM merges JOIN uids USING (table_uid) WHERE kind <> 4')


@query()
def r17_refusals(spark, sf_dir):
    found = mended(spark, sf_dir)[2]
    return found.withColumn("cells", F.array_join(F.transform("cells", lambda x: x.cast("string")), ","))


oracle("r17_refusals", """ SELECT table_uid, (row_number() OVER (PARTITION BY table_uid ORDER BY g))::INTEGER AS n, 'column' AS line, 0 AS index, ((g * c + 1) * 3)::INTEGER AS "into", string_agg(((g * c + i + 1) * 3)::VARCHAR, ',' ORDER BY i) AS cells, 'children_not_repeated' AS reason FROM wide JOIN uids USING (t, kind, b, c) WHERE kind = 1 AND i > 0 GROUP BY table_uid, g, c
UNION ALL SELECT table_uid, 1, 'column', 0, NULL, string_agg(((g * c + i + 1) * 3)::VARCHAR, ',' ORDER BY g, i), 'block_without_label_on_top' FROM wide JOIN uids USING (t, kind, b, c) WHERE kind = 2 AND i > CASE g WHEN 0 THEN 1 ELSE 0 END GROUP BY table_uid""")


@query()
def r18_group_rows(spark, sf_dir):
    """Rows that a label over the line right of the header columns groups, and the blanks that join it."""
    slots, cells, targets = parts(spark, sf_dir)
    broken = repair.witnesses(slots, targets).select("table_uid", "hmd", F.explode("cells_0").alias("cell_id"))
    return repair.group_rows(slots, cells, broken)


oracle("r18_group_rows", ' SELECT table_uid, cell_id::INTEGER AS cell_id, into_::INTEGER AS "into", direction, r::INTEGER AS first_row, r::INTEGER AS last_row, first_col::INTEGER AS first_col, first_col::INTEGER AS last_col FROM merges JOIN uids USING (table_uid) WHERE kind = 4')


@query()
def r19_repairs(spark, sf_dir):
    return mended(spark, sf_dir)[0]


oracle("r19_repairs", " SELECT table_uid, CASE kind WHEN 5 THEN 2 ELSE 1 END AS hmd, CASE WHEN kind < 3 THEN 2 ELSE 1 END AS vmd, CASE WHEN kind IN (0, 4, 5) THEN 'repaired' WHEN kind = 3 THEN 'already_offered' ELSE 'refused' END AS status, CASE WHEN kind = 4 THEN 'layout' WHEN kind IN (0, 3, 5) THEN 'boundary' END AS matched FROM uids")


@query()
def r20_repaired_candidates(spark, sf_dir):
    """Candidates of the tables as they are after their merges, with the cells that are left."""
    slots, cells, _ = parts(spark, sf_dir)
    made = mended(spark, sf_dir)[1]
    touched = made.select("table_uid").distinct()
    after = repair.merged_slots(slots.join(touched, "table_uid", "left_semi"), made)
    left = repair.merged_cells(cells.join(touched, "table_uid", "left_semi"), made).groupBy("table_uid").agg(F.count("*").alias("n_cells"))
    return g.candidate_ids(g.boundaries(after)).join(left, "table_uid").select("table_uid", "candidate_id", "hmd", "vmd", "n_cells")


# 0: the first column merged, so one header row and up to two header columns; 4: the row's one cell, as plain data or as a
# second header row, is crossed by no line of (2, 0) only; 5: two header rows, and one header column or none
oracle("r20_repaired_candidates", """, wanted AS (SELECT * FROM (VALUES (0, 1, 0), (0, 1, 1), (0, 1, 2), (4, 1, 0), (5, 2, 0), (5, 2, 1)) v(kind, hmd, vmd))
SELECT table_uid, 'h' || hmd || '_v' || vmd AS candidate_id, hmd, vmd, CASE kind WHEN 0 THEN (b * c + 1) * 3 - b * (c - 1) WHEN 4 THEN (b * c + 2) * 3 - 2 ELSE 4 * (b * c + 1) - b * (c - 1) END::BIGINT AS n_cells FROM uids JOIN wanted USING (kind)""")


@query()
def r21_repair_audit(spark, sf_dir):
    """Stored merges against those made, where every fifth article's are stored without the last merge and those of the
    next articles with another direction."""
    made = mended(spark, sf_dir)[1]
    no = F.regexp_extract("table_uid", "PMC([0-9]+)/", 1).cast("long") % 5
    last = made.groupBy("table_uid").agg(F.max("n").alias("last"))
    stored = made.join(last, "table_uid").where((no != 0) | (F.col("n") != F.col("last"))).withColumn("direction", F.when((no == 1) & (F.col("n") == F.col("last")), "right").otherwise(F.col("direction")))
    return repair.recheck(stored, made)


oracle("r21_repair_audit", " SELECT DISTINCT table_uid, (t % 5)::BIGINT AS only_stored, 1::BIGINT AS only_made FROM merges JOIN uids USING (table_uid) WHERE t % 5 < 2")


@query()
def r6_repair_decisions(spark, sf_dir):
    """Answers that name the targets, decided by candidates where one has the counts, else by the repair."""
    slots, _, targets = parts(spark, sf_dir)
    matched = targets.join(repair.marginal_counts(slots), ["table_uid", "hmd", "vmd"], "left")
    status = F.when(F.col("kind").isNotNull(), "valid").otherwise("unparseable")
    decided = matched.select("table_uid", status.alias("final_status"), F.when(F.col("kind").isNotNull(), F.format_string("h%d_v%d", "hmd", "vmd")).alias("candidate_id"))
    return repair.decided_by_repair(decided, mended(spark, sf_dir)[0])


oracle("r6_repair_decisions", " SELECT table_uid, CASE WHEN kind IN (1, 2) THEN 'unparseable' ELSE 'valid' END AS final_status, CASE kind WHEN 0 THEN 'repaired/h1_v2' WHEN 3 THEN 'h1_v1' WHEN 4 THEN 'repaired/h1_v1' WHEN 5 THEN 'repaired/h2_v1' END AS candidate_id, CASE WHEN kind IN (0, 4, 5) THEN 'repair' ELSE 'answer' END AS decided_by FROM uids")
