"""Whether headers label each line of a table once: paths of header cells, counted in the graph and line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.geometry import TABLE, column_paths, extents
from tablewright.sources.shared import kept

KEY = [TABLE, "hmd", "vmd"]
#: Counts of paths go no higher.
MOST_PATHS = 10**15
# Reasons of the published certificates, in their order.
NOT_RECTANGLE, OUT_OF_RANGE, CROSSES_HMD, CROSSES_VMD = "cell_not_rectangular", "boundary_out_of_range", "cell_crosses_hmd_line", "cell_crosses_vmd_line"
NO_HEADER, SHARED_PATH, MORE_PATHS = "no_header_on_claimed_axis", "lines_share_a_path", "graph_has_paths_without_line"


def header_path_counts(slots: DataFrame, targets: DataFrame) -> DataFrame:
    """(table_uid, hmd, vmd, n_paths): the paths from the first header row to the last in the graph of header cells over
    the data columns, a cell having an edge to every other cell right below it.

    Counted from the last header row upwards, a row of all tables at a time: a cell that goes on below keeps its count,
    another has the sum of those below it, at most MOST_PATHS. A boundary without header rows has no row here.
    """
    head = kept(targets.select(*KEY).distinct().where("hmd > 0").join(slots, TABLE).where("row_idx < hmd AND col_idx >= vmd").withColumn("level", F.col("hmd") - 1 - F.col("row_idx")).select(*KEY, "level", "col_idx", "cell_id"))
    deepest = head.agg(F.max("level")).first()[0]
    if deepest is None:
        return targets.select(*KEY).limit(0).withColumn("n_paths", F.lit(0).cast("long"))
    counts = kept(head.where("level = 0").select(*KEY, "cell_id").distinct().withColumn("n", F.lit(1).cast("long")))
    total = lambda level, found: found.where(F.col("hmd") == level + 1).groupBy(*KEY).agg(F.least(F.sum("n"), F.lit(MOST_PATHS)).alias("n_paths"))
    done = total(0, counts)
    for level in range(1, deepest + 1):
        here = head.where(F.col("level") == level).select(*KEY, "col_idx", F.col("cell_id").alias("upper"))
        below = head.where(F.col("level") == level - 1).select(*KEY, "col_idx", "cell_id")
        edges = here.join(below, [*KEY, "col_idx"]).select(*KEY, "upper", "cell_id").distinct().join(counts, [*KEY, "cell_id"])
        own = F.max(F.when(F.col("upper") == F.col("cell_id"), F.col("n")))
        counts = kept(edges.groupBy(*KEY, F.col("upper").alias("cell_id")).agg(F.least(F.coalesce(own, F.sum("n")), F.lit(MOST_PATHS)).alias("n")))
        done = done.unionByName(total(level, counts))
    return done


def axis(slots: DataFrame, targets: DataFrame) -> DataFrame:
    """(table_uid, hmd, vmd, reason): why the columns are not labelled each by a path of its own, null if they are."""
    named = targets.select(*KEY).distinct().withColumn("candidate_id", F.concat_ws(",", "hmd", "vmd"))
    text = F.array_join(F.transform("path", lambda x: x.cast("string")), ">")
    paths = column_paths(slots, named).groupBy(TABLE, "candidate_id").agg(F.count("*").alias("n_lines"), F.countDistinct(text).alias("n_distinct"))
    at = named.join(paths, [TABLE, "candidate_id"], "left").join(header_path_counts(slots, targets), KEY, "left")
    reason = F.when(F.col("hmd") < 1, NO_HEADER).when(F.col("n_distinct") < F.col("n_lines"), SHARED_PATH).when(F.col("n_paths") != F.col("n_lines"), MORE_PATHS)
    return at.select(*KEY, reason.alias("reason"))


def certify(slots: DataFrame, targets: DataFrame) -> DataFrame:
    """(table_uid, hmd, vmd, claim, columns_reason, rows_reason): the axis whose lines a boundary labels, columns if it
    does, else rows, else null, with the first reason against each that was looked at.

    Reasons: cell_not_rectangular, boundary_out_of_range, cell_crosses_hmd_line and cell_crosses_vmd_line hold for both;
    no_header_on_claimed_axis, lines_share_a_path, and graph_has_paths_without_line, where header cells overlap so that the
    graph has paths that are no line's.
    """
    size = slots.groupBy(TABLE).agg((F.max("row_idx") + 1).alias("n_rows"), (F.max("col_idx") + 1).alias("n_cols"))
    boxes = extents(slots)
    odd = boxes.groupBy(TABLE).agg(F.bool_or(~F.col("filled")).alias("odd"))
    asked = targets.select(*KEY).distinct().join(size, TABLE).join(odd, TABLE)
    inside = asked.where("NOT odd AND hmd BETWEEN 0 AND n_rows - 1 AND vmd BETWEEN 0 AND n_cols - 1").select(*KEY)
    crossed = inside.join(boxes, TABLE).groupBy(*KEY).agg(
        F.bool_or((F.col("first_row") < F.col("hmd")) & (F.col("last_row") >= F.col("hmd"))).alias("over_hmd"),
        F.bool_or((F.col("last_row") >= F.col("hmd")) & (F.col("first_col") < F.col("vmd")) & (F.col("last_col") >= F.col("vmd"))).alias("over_vmd"),
    )
    known = kept(asked.join(crossed, KEY, "left"))
    sound = known.where("NOT over_hmd AND NOT over_vmd").select(*KEY)
    columns = axis(slots, sound).withColumnRenamed("reason", "columns_reason")
    turned = slots.select(TABLE, F.col("col_idx").alias("row_idx"), F.col("row_idx").alias("col_idx"), "cell_id")
    rows = axis(turned, sound.select(TABLE, F.col("vmd").alias("hmd"), F.col("hmd").alias("vmd"))).select(TABLE, F.col("vmd").alias("hmd"), F.col("hmd").alias("vmd"), F.col("reason").alias("rows_reason"))
    both = known.join(columns, KEY, "left").join(rows, KEY, "left")
    shared = F.when(F.col("odd"), NOT_RECTANGLE).when(F.col("over_hmd").isNull(), OUT_OF_RANGE).when(F.col("over_hmd"), CROSSES_HMD).when(F.col("over_vmd"), CROSSES_VMD)
    why = F.coalesce(shared, "columns_reason")
    claim = F.when(why.isNull(), "columns").when(shared.isNull() & F.col("rows_reason").isNull(), "rows")
    return both.select(*KEY, claim.alias("claim"), why.alias("columns_reason"), F.when(why.isNotNull(), F.coalesce(shared, "rows_reason")).alias("rows_reason"))
