"""Structure of rasterised tables: slots, cells, header boundaries, labels.

slots: (table_uid, row_idx, col_idx, cell_id), one row per grid place; a merged cell's id repeats over its
places. A boundary (hmd, vmd) says how many top rows and left columns are headers. Everything is keyed by
table_uid; a plan of several windows, groupings and joins by different keys below it has an exchange for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TABLE = "table_uid"


def raster_to_slots(tables: DataFrame) -> DataFrame:
    """tables (table_uid, raster array<array<int>>) to slots; a null raster has none."""
    rows = tables.select(TABLE, F.posexplode("raster").alias("row_idx", "ids"))
    return rows.select(TABLE, "row_idx", F.posexplode("ids").alias("col_idx", "cell_id"))


def slots_to_raster(slots: DataFrame) -> DataFrame:
    rows = slots.groupBy(TABLE, "row_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("col_idx", "cell_id"))), lambda s: s["cell_id"]).alias("ids"))
    return rows.groupBy(TABLE).agg(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "ids"))), lambda s: s["ids"]).alias("raster"))


def shape(slots: DataFrame) -> DataFrame:
    """(table_uid, rows, columns, slots, cells, rectangular)"""
    per = slots.groupBy(TABLE).agg((F.max("row_idx") + 1).alias("n_rows"), (F.max("col_idx") + 1).alias("n_cols"), F.count("*").alias("n_slots"), F.countDistinct("cell_id").alias("n_cells"))
    return per.withColumn("rectangular", F.col("n_rows") * F.col("n_cols") == F.col("n_slots"))


def extents(slots: DataFrame) -> DataFrame:
    """First and last row and column of every cell, and whether it fills its rectangle."""
    per = slots.groupBy(TABLE, "cell_id").agg(F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"), F.min("col_idx").alias("first_col"), F.max("col_idx").alias("last_col"), F.count("*").alias("n_slots"))
    return per.withColumn("filled", F.col("n_slots") == (F.col("last_row") - F.col("first_row") + 1) * (F.col("last_col") - F.col("first_col") + 1))


def plain_grids(slots: DataFrame) -> DataFrame:
    """Whether no cell of a table covers two places."""
    return slots.groupBy(TABLE).agg((F.count("*") == F.countDistinct("cell_id")).alias("plain"))


def adjacency(slots: DataFrame) -> DataFrame:
    """Each place's cell with those to the right, below and diagonally below; null past the edge."""
    across, down = W.partitionBy(TABLE, "row_idx").orderBy("col_idx"), W.partitionBy(TABLE, "col_idx").orderBy("row_idx")
    right = slots.withColumn("right_id", F.lead("cell_id").over(across))
    return right.withColumn("below_id", F.lead("cell_id").over(down)).withColumn("diagonal_id", F.lead("right_id").over(down))


def row_summaries(adjacent: DataFrame) -> DataFrame:
    """Per row the last column where a neighbour pair is one cell, a cell goes on below, splits below, or
    joins below; -1 for none."""
    id_, right, below, diagonal = (F.col(c) for c in ("cell_id", "right_id", "below_id", "diagonal_id"))
    last = lambda test: F.coalesce(F.max(F.when(test, F.col("col_idx"))), F.lit(-1))
    return adjacent.groupBy(TABLE, "row_idx").agg(
        last(id_ == right).alias("same"), last(id_ == below).alias("crossing"), last((id_ == right) & (below != diagonal)).alias("split"), last((id_ != right) & (below == diagonal)).alias("joined"),
    )


def column_summaries(adjacent: DataFrame) -> DataFrame:
    """As row_summaries, with rows and columns exchanged."""
    id_, right, below, diagonal = (F.col(c) for c in ("cell_id", "right_id", "below_id", "diagonal_id"))
    last = lambda test: F.coalesce(F.max(F.when(test, F.col("row_idx"))), F.lit(-1))
    return adjacent.groupBy(TABLE, "col_idx").agg(
        last(id_ == right).alias("crossing"), last((id_ == below) & (right != diagonal)).alias("split"), last((id_ != below) & (right == diagonal)).alias("joined"),
    )


def earlier(summary: DataFrame, by: str, missing: str) -> DataFrame:
    """With the least split and greatest join of strictly earlier rows (columns); `missing` columns (rows) and -1 for none."""
    before = W.partitionBy(TABLE).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    return summary.withColumn("least_split", F.coalesce(F.min("split").over(before), F.col(missing))).withColumn("most_joined", F.coalesce(F.max("joined").over(before), F.lit(-1)))


def boundaries(slots: DataFrame) -> DataFrame:
    """(table_uid, hmd, vmd): every header boundary that the merged cells allow.

    Row and column summaries meet by range predicates inside each table, so the work is rows x columns of
    a table at most, and no place is compared with another. A table's first row (column) brings a row (column) -1 with
    it, the last of no header rows (columns), so that one join finds all.
    """
    adjacent = adjacency(slots)
    size = slots.groupBy(TABLE).agg((F.max("row_idx") + 1).alias("n_rows"), (F.max("col_idx") + 1).alias("n_cols"), (F.count("*") == F.countDistinct("cell_id")).alias("plain"))
    r, c = F.col("row_idx"), F.col("col_idx")
    number = lambda by: F.row_number().over(W.partitionBy(TABLE).orderBy(by))
    rows = earlier(row_summaries(adjacent).join(size, TABLE), "row_idx", "n_cols").withColumn("number", number("row_idx"))
    cols = earlier(column_summaries(adjacent).join(size, TABLE), "col_idx", "n_rows").withColumn("number", number("col_idx"))
    begun = lambda df, none, at: df.select(TABLE, "n_rows", "n_cols", "plain", F.inline(F.when(F.col("number") == 1, F.array(F.struct(*none), F.struct(*at))).otherwise(F.array(F.struct(*at)))))
    none = lambda at, *rest: [F.lit(-1).alias(at), *[x.alias(name) for name, x in rest]]
    nothing = F.lit(-1)
    heads = begun(rows, none("row_idx", ("same", nothing), ("crossing", nothing), ("least_split", F.col("n_cols")), ("most_joined", nothing)), ["row_idx", "same", "crossing", "least_split", "most_joined"])
    heads = heads.where((r < F.col("n_rows") - 1) & (F.col("crossing") < 0))
    sides = begun(cols, none("col_idx", ("crossing", nothing), ("least_split", F.col("n_rows")), ("most_joined", nothing)), ["col_idx", "crossing", "least_split", "most_joined"])
    sides = sides.where((c < 0) | (c < F.col("n_cols") - 1)).select(TABLE, "col_idx", F.col("crossing").alias("c_crossing"), F.col("least_split").alias("c_split"), F.col("most_joined").alias("c_joined"))
    inside = (F.greatest(c, F.lit(0)) >= F.col("same") + 1) & (c >= F.col("most_joined")) & (c <= F.col("least_split") - 1) & (F.col("c_crossing") <= r) & (F.col("c_split") > r) & (F.col("c_joined") < F.greatest(r, F.lit(0)))
    some = (r >= 0) | (F.col("plain") & (c >= 0))
    return heads.join(sides, TABLE).where(inside & some).select(TABLE, (r + 1).alias("hmd"), (c + 1).alias("vmd"))


#: Broken rules in the order in which the first is reported.
RULE_ORDER = (7, 8, 9, 0, 1, 2, 3, 4, 5, 6)


def rule_checks(slots: DataFrame, targets: DataFrame) -> DataFrame:
    """Which of the ten rules each given boundary (table_uid, hmd, vmd) breaks: columns rule_0 to rule_9, and
    first_broken by RULE_ORDER, -1 if it breaks none, -2 if it is outside the table.

    0 a cell crosses the vertical line below the header rows; 1 a cell crosses the horizontal line; 2 a
    header row but the last has no merged cell that the next row splits; 3 the same for header columns;
    4, 5 a header row (column) merges what the one before splits; 6 a merged cell in the last header row from
    the last header column on; 7 no header; 8 no data; 9 no header rows in a table with merged cells.
    """
    adjacent = adjacency(slots)
    size = slots.groupBy(TABLE).agg((F.max("row_idx") + 1).alias("n_rows"), (F.max("col_idx") + 1).alias("n_cols"), (F.count("*") == F.countDistinct("cell_id")).alias("plain"))
    at = targets.select(TABLE, "hmd", "vmd").distinct().join(size, TABLE).join(adjacent, TABLE)
    r, c, h, v = (F.col(x) for x in ("row_idx", "col_idx", "hmd", "vmd"))
    id_, right, below, diagonal = (F.col(x) for x in ("cell_id", "right_id", "below_id", "diagonal_id"))
    any_ = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    key = [TABLE, "hmd", "vmd"]
    per = at.groupBy(*key).agg(
        any_((r >= h) & (c == v - 1) & (id_ == right)).alias("rule_0"),
        any_((r == h - 1) & (id_ == below)).alias("rule_1"),
        any_((r < h - 1) & (c >= v) & (id_ != right) & (below == diagonal)).alias("rule_4"),
        any_((c < v - 1) & (r >= h - 1) & (id_ != below) & (right == diagonal)).alias("rule_5"),
        any_((r == h - 1) & (c >= v - 1) & (id_ == right)).alias("rule_6"),
        F.first((h == 0) & (v == 0)).alias("rule_7"),
        F.first((h >= F.col("n_rows")) | (v >= F.col("n_cols"))).alias("rule_8"),
        F.first((h == 0) & ~F.col("plain")).alias("rule_9"),
        F.first((h < 0) | (v < 0) | (h > F.col("n_rows")) | (v > F.col("n_cols"))).alias("outside"),
    )
    unsplit_row = at.where(r < h - 1).groupBy(*key, "row_idx").agg(any_((c >= v) & (id_ == right) & (below != diagonal)).alias("splits"))
    unsplit_col = at.where(c < v - 1).groupBy(*key, "col_idx").agg(any_((r >= h) & (id_ == below) & (right != diagonal)).alias("splits"))
    by_row = unsplit_row.groupBy(*key).agg(F.bool_or(~F.col("splits")).alias("rule_2"))
    by_col = unsplit_col.groupBy(*key).agg(F.bool_or(~F.col("splits")).alias("rule_3"))
    out = per.join(by_row, key, "left").join(by_col, key, "left").fillna(False, ["rule_2", "rule_3"])
    first = F.when(F.col("outside"), -2)
    for n in RULE_ORDER:
        first = first.when(F.col(f"rule_{n}"), n)
    return out.select(TABLE, "hmd", "vmd", *[f"rule_{n}" for n in range(10)], first.otherwise(-1).alias("first_broken"))


def separators(slots: DataFrame) -> DataFrame:
    """(table_uid, row_idx): rows of at least two columns covered by a single cell."""
    per = slots.groupBy(TABLE, "row_idx").agg(F.countDistinct("cell_id").alias("ids"), F.count("*").alias("places"))
    return per.where("ids = 1 AND places > 1").select(TABLE, "row_idx")


def region_separators(slots: DataFrame, candidates: DataFrame) -> DataFrame:
    """(table_uid, hmd, vmd, row_idx): data rows of a boundary covered by one cell over all data columns."""
    data = candidates.select(TABLE, "hmd", "vmd").join(slots, TABLE).where("row_idx >= hmd AND col_idx >= vmd")
    per = data.groupBy(TABLE, "hmd", "vmd", "row_idx").agg(F.countDistinct("cell_id").alias("ids"), F.count("*").alias("places"))
    return per.where("ids = 1 AND places > 1").select(TABLE, "hmd", "vmd", "row_idx")


def strip_separators(slots: DataFrame) -> DataFrame:
    """slots without separator rows, rows numbered anew, the old number as source_row."""
    kept = slots.join(separators(slots), [TABLE, "row_idx"], "left_anti")
    number = F.dense_rank().over(W.partitionBy(TABLE).orderBy("row_idx")) - 1
    return kept.select(TABLE, number.alias("row_idx"), "col_idx", "cell_id", F.col("row_idx").alias("source_row"))


def candidate_ids(found: DataFrame) -> DataFrame:
    """Candidates numbered in order of hmd and vmd: ord from 0 and candidate_id h<hmd>_v<vmd>."""
    ord_ = F.row_number().over(W.partitionBy(TABLE).orderBy("hmd", "vmd")) - 1
    return found.withColumn("ord", ord_).withColumn("candidate_id", F.concat(F.lit("h"), F.col("hmd").cast("string"), F.lit("_v"), F.col("vmd").cast("string")))


def statuses(tables: DataFrame, candidates: DataFrame) -> DataFrame:
    """unique, ambiguous or abstained for every table, by its number of candidates."""
    n = candidates.groupBy(TABLE).agg(F.count("*").alias("n_candidates"))
    out = tables.select(TABLE).distinct().join(n, TABLE, "left").fillna(0, ["n_candidates"])
    return out.withColumn("status", F.when(F.col("n_candidates") == 0, "abstained").when(F.col("n_candidates") == 1, "unique").otherwise("ambiguous"))


def labels(candidates: DataFrame, cells: DataFrame) -> DataFrame:
    """(table_uid, candidate_id, cell_id, region): a cell has the region of its top-left place."""
    region = F.when(F.col("row_idx") < F.col("hmd"), "hmd").when(F.col("col_idx") < F.col("vmd"), "vmd").otherwise("data")
    return candidates.select(TABLE, "candidate_id", "hmd", "vmd").join(cells.select(TABLE, "cell_id", "row_idx", "col_idx"), TABLE).select(TABLE, "candidate_id", "cell_id", region.alias("region"))


def boundary_regions(slots: DataFrame, targets: DataFrame) -> DataFrame:
    """Regions of all cells for a given boundary, only for boundaries that cut no cell."""
    region = F.when(F.col("row_idx") < F.col("hmd"), "hmd").when(F.col("col_idx") < F.col("vmd"), "vmd").otherwise("data")
    per = targets.select(TABLE, "hmd", "vmd").join(slots, TABLE).groupBy(TABLE, "hmd", "vmd", "cell_id").agg(F.min(region).alias("region"), F.max(region).alias("other"))
    cut = F.bool_or(F.col("region") != F.col("other")).over(W.partitionBy(TABLE, "hmd", "vmd"))
    return per.withColumn("cut", cut).where("NOT cut").drop("other", "cut")


def column_paths(slots: DataFrame, candidates: DataFrame) -> DataFrame:
    """(table_uid, candidate_id, line, path): header cells over each data column, top down, a cell once in a row."""
    above = candidates.select(TABLE, "candidate_id", "hmd", "vmd").join(slots, TABLE).where("row_idx < hmd AND col_idx >= vmd")
    before = F.lag("cell_id").over(W.partitionBy(TABLE, "candidate_id", "col_idx").orderBy("row_idx"))
    kept = above.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("cell_id")))
    return kept.groupBy(TABLE, "candidate_id", F.col("col_idx").alias("line")).agg(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "cell_id"))), lambda s: s["cell_id"]).alias("path"))


def row_paths(slots: DataFrame, candidates: DataFrame) -> DataFrame:
    """(table_uid, candidate_id, line, path): header cells left of each data row, left to right."""
    turned = slots.select(TABLE, F.col("col_idx").alias("row_idx"), F.col("row_idx").alias("col_idx"), "cell_id")
    return column_paths(turned, candidates.select(TABLE, "candidate_id", F.col("vmd").alias("hmd"), F.col("hmd").alias("vmd")))


def distinct_paths(paths: DataFrame) -> DataFrame:
    """Whether all lines of a candidate have header paths of their own."""
    as_text = F.array_join(F.transform("path", lambda x: x.cast("string")), ">")
    return paths.groupBy(TABLE, "candidate_id").agg(F.count("*").alias("n_lines"), (F.count("*") == F.countDistinct(as_text)).alias("distinct_paths"))


def differences(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Rows that only one of two versions has, with side stored or computed. Rows that both have equally often leave first, by
    joins that move nothing between versions dealt by one of the columns."""
    columns = stored.columns
    counted = lambda df: df.groupBy(*columns).agg(F.count("*").alias("_n"))
    rest = lambda a, b: a.join(b, [*columns, "_n"], "left_anti").select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).select(*columns)
    mine, others = counted(stored), counted(computed.select(*columns))
    stored, other = rest(mine, others), rest(others, mine)
    return stored.exceptAll(other).withColumn("side", F.lit("stored")).unionByName(other.exceptAll(stored).withColumn("side", F.lit("computed")))


#: Budgets of one table and one article.
TABLE_LIMITS = {"n_rows": 1000, "n_cols": 256, "n_cells": 10_000, "n_slots": 100_000}
ARTICLE_TABLES, ARTICLE_SLOTS, CANDIDATE_LABELS = 256, 250_000, 500_000


def table_budget(shapes: DataFrame) -> DataFrame:
    """The first budget that a table breaks, null if none."""
    over = F.lit(None).cast("string")
    for name, most in reversed(TABLE_LIMITS.items()):
        over = F.when(F.col(name) > most, name).otherwise(over)
    return shapes.withColumn("over_budget", over)


def article_budget(shapes: DataFrame) -> DataFrame:
    """Running totals in table order by article and whether the article is still within its budgets there.
    shapes: pmc_id, table_index, n_slots."""
    w = W.partitionBy("pmc_id").orderBy("table_index").rowsBetween(W.unboundedPreceding, 0)
    out = shapes.select("pmc_id", "table_index", F.sum("n_slots").over(w).alias("slots_so_far"), F.count("*").over(w).alias("tables_so_far"))
    return out.withColumn("within", (F.col("slots_so_far") <= ARTICLE_SLOTS) & (F.col("tables_so_far") <= ARTICLE_TABLES))


def label_budget(candidates: DataFrame, shapes: DataFrame) -> DataFrame:
    """Tables whose labels (candidates x cells) stay within the budget."""
    n = candidates.groupBy(TABLE).agg(F.count("*").alias("n_candidates"))
    return n.join(shapes.select(TABLE, "n_cells"), TABLE).withColumn("n_labels", F.col("n_candidates") * F.col("n_cells")).where(F.col("n_labels") <= CANDIDATE_LABELS)
