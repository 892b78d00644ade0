"""Blank cells joined to their labels, so that a refused boundary becomes a candidate.

A blank below a label (or right of one in a header row) may belong to it. It is joined only where the table gives
evidence: the cells beside the label's block repeat, text by text, beside another block of the same line, and every run
of the line starts with a label. A label that starts in the first column and crosses the line right of the header
columns takes the blanks that are all that follows it in its row. All tables are mended at once, a line of each at a
time, in rounds; every round reads the tables that the last one wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.functions.text import normalized
from tablewright.operators.geometry import TABLE, adjacency, boundaries, differences, extents, separators, strip_separators
from tablewright.sources.shared import kept

ROUNDS = 10
#: Reasons of refusals.
NOT_REPEATED, NO_LABEL_ON_TOP = "children_not_repeated", "block_without_label_on_top"
MERGES = "table_uid string, n int, cell_id int, into int, direction string, first_row int, last_row int, first_col int, last_col int"
REFUSED = "table_uid string, n int, line string, index int, into int, cells array<int>, reason string"


def witnesses(slots: DataFrame, targets: DataFrame) -> DataFrame:
    """What breaks each rule for boundaries inside their tables (table_uid, hmd, vmd): cells_0, cells_1, cells_4, cells_5,
    cells_6 and cells_9, ids in order, rows_2 and columns_3, the header rows and columns without evidence, and no_header (7),
    no_rows and no_columns left for data (8). See geometry.rule_checks for the rules."""
    adjacent = adjacency(slots)
    size = slots.groupBy(TABLE).agg((F.max("row_idx") + 1).alias("n_rows"), (F.max("col_idx") + 1).alias("n_cols"))
    merged = slots.groupBy(TABLE, "cell_id").agg(F.count("*").alias("n")).where("n > 1").groupBy(TABLE).agg(F.sort_array(F.collect_list("cell_id")).alias("merged"))
    at = targets.select(TABLE, "hmd", "vmd").distinct().join(size.join(merged, TABLE, "left"), TABLE).join(adjacent, TABLE)
    r, c, h, v = (F.col(x) for x in ("row_idx", "col_idx", "hmd", "vmd"))
    id_, right, below, diagonal = (F.col(x) for x in ("cell_id", "right_id", "below_id", "diagonal_id"))
    ids = lambda test, cell=id_: F.sort_array(F.collect_set(F.when(test, cell)))
    key = [TABLE, "hmd", "vmd"]
    per = at.groupBy(*key).agg(
        ids((r >= h) & (c == v - 1) & (id_ == right)).alias("cells_0"), ids((r == h - 1) & (id_ == below)).alias("cells_1"),
        ids((r < h - 1) & (c >= v) & (id_ != right) & (below == diagonal), below).alias("cells_4"), ids((c < v - 1) & (r >= h - 1) & (id_ != below) & (right == diagonal), right).alias("cells_5"),
        ids((r == h - 1) & (c >= v - 1) & (id_ == right)).alias("cells_6"), F.first(F.when((h == 0), F.col("merged"))).alias("cells_9"),
        F.first((h == 0) & (v == 0)).alias("no_header"), F.first(h >= F.col("n_rows")).alias("no_rows"), F.first(v >= F.col("n_cols")).alias("no_columns"),
    )
    lacking = lambda line, test, splits: at.where(test).groupBy(*key, line).agg(F.coalesce(F.bool_or(splits), F.lit(False)).alias("splits")).where("NOT splits").groupBy(*key).agg(F.sort_array(F.collect_list(line)).alias(line))
    rows = lacking("row_idx", r < h - 1, (c >= v) & (id_ == right) & (below != diagonal)).withColumnRenamed("row_idx", "rows_2")
    columns = lacking("col_idx", c < v - 1, (r >= h) & (id_ == below) & (right != diagonal)).withColumnRenamed("col_idx", "columns_3")
    none = F.array().cast("array<int>")
    out = per.join(rows, key, "left").join(columns, key, "left")
    return out.withColumns({n: F.coalesce(n, none) for n in ("cells_9", "rows_2", "columns_3")})


def facts(slots: DataFrame, cells: DataFrame) -> DataFrame:
    """extents with the text of each cell, white space normalised, and whether it is empty (as a gap is)."""
    gap = F.col("kind") == "synthetic_gap" if "kind" in cells.columns else F.lit(False)
    said = cells.select(TABLE, "cell_id", F.coalesce(normalized(F.col("text")), F.lit("")).alias("text"), gap.alias("gap"))
    found = extents(slots).join(said, [TABLE, "cell_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    return found.withColumn("empty", (F.col("text") == "") | F.coalesce("gap", F.lit(False))).drop("gap")


def marginal_counts(slots: DataFrame) -> DataFrame:
    """(table_uid, hmd, vmd, kind): the counts that mean a candidate of one subtable, as a reviewer reads them: from the
    table's top to the last header row. kind is layout where rows are set aside."""
    rest = strip_separators(slots)
    found = boundaries(rest.drop("source_row"))
    data = found.join(rest, TABLE).where("row_idx >= hmd AND col_idx >= vmd").groupBy(TABLE, "hmd", "vmd", "row_idx").agg(F.countDistinct("cell_id").alias("ids"), F.count("*").alias("places"))
    whole = (F.col("ids") == 1) & (F.col("places") > 1)
    left = data.groupBy(TABLE, "hmd", "vmd").agg(F.count_if(~whole).alias("left"), F.count_if(whole).alias("aside")).where("left > 0")
    source = rest.select(TABLE, (F.col("row_idx") + 1).alias("hmd"), (F.col("source_row") + 1).alias("read")).distinct()
    titled = separators(slots).select(TABLE).distinct().withColumn("titled", F.lit(True))
    known = left.join(source, [TABLE, "hmd"], "left").join(titled, TABLE, "left")
    return known.select(TABLE, F.coalesce("read", F.lit(0)).alias("hmd"), "vmd", F.when(F.col("titled") | (F.col("aside") > 0), "layout").otherwise("boundary").alias("kind"))


def line_merges(line: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merges (table_uid, line, index, pos, cell_id, into) and refusals (table_uid, line, index, into, cells, reason) of
    one line of each table.

    line: a row for every place along it, pos in order: cell_id, text and empty; begins, whether the cell begins there;
    last, its last place; cross, its extent across the line; stop, where no block goes on; joins, whether the line before
    is one cell over this place and the one before it; child and child_text, the cell beside it; counted, whether the
    place belongs to blocks; top, whether a label must begin there; whole, whether the line has cells beside it.
    """
    key = [TABLE, "line", "index"]
    order = W.partitionBy(*key).orderBy("pos")
    events = line.where("begins OR stop")
    fits = F.col("joins") & (F.lag("last").over(order) + 1 == F.col("pos")) & (F.lag("cross").over(order) == F.col("cross")) & ~F.lag("stop").over(order)
    blank = F.col("empty") & ~F.col("stop") & F.coalesce(fits, F.lit(False))
    island = W.partitionBy(*key, "island").orderBy("pos")
    chained = events.withColumn("blank", blank).withColumn("island", F.sum((~F.col("blank")).cast("int")).over(order))
    chained = chained.withColumn("head", F.first(F.when(~F.col("stop") & ~F.col("empty"), F.col("cell_id"))).over(island))
    tentative = kept(chained.where("blank AND head IS NOT NULL").select(*key, "pos", "cell_id", F.col("head").alias("into")))

    tops = line.where("top").groupBy(*key).agg(F.bool_and(F.col("begins") & ~F.col("empty")).alias("labelled"))
    lines = line.groupBy(*key).agg(F.bool_and("whole").alias("whole")).join(tops, key, "left").select(*key, (F.coalesce("labelled", F.lit(True)) & F.col("whole")).alias("sound"))

    joined = line.where("counted").join(tentative.select(*key, "cell_id", "into"), [*key, "cell_id"], "left")
    own = joined.withColumn("block_id", F.coalesce("into", "cell_id"))
    numbered = own.withColumn("new", (~F.col("block_id").eqNullSafe(F.lag("block_id").over(order))).cast("int")).withColumn("block", F.sum("new").over(order))
    inside = W.partitionBy(*key, "block").orderBy("pos")
    children = numbered.withColumn("again", F.coalesce(F.lag("child").over(inside) == F.col("child"), F.lit(False)))
    signed = F.transform(F.sort_array(F.collect_list(F.when(~F.col("again"), F.struct("pos", F.lower("child_text").alias("t"))))), lambda s: s["t"])
    labelled = F.bool_or((F.col("block_id") == F.col("cell_id")) & ~F.col("empty"))
    blocks = children.groupBy(*key, "block").agg(F.first("block_id").alias("into"), F.count("*").alias("size"), signed.alias("signature"), labelled.alias("labelled")).where("size >= 2 AND labelled")
    repeated = blocks.withColumn("n", F.count("*").over(W.partitionBy(*key, "signature"))).where("n > 1").select(*key, "into").distinct().withColumn("confirmed", F.lit(True))

    judged = tentative.join(lines, key).join(repeated, [*key, "into"], "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))
    merges = judged.where("sound AND confirmed").select(*key, "pos", "cell_id", "into")
    cells = F.transform(F.sort_array(F.collect_list(F.struct("pos", "cell_id"))), lambda s: s["cell_id"])
    alone = judged.where("sound AND NOT confirmed").groupBy(*key, "into").agg(F.min("pos").alias("at"), cells.alias("cells")).withColumn("reason", F.lit(NOT_REPEATED))
    whole = judged.where("NOT sound").groupBy(*key).agg(F.min("pos").alias("at"), cells.alias("cells")).withColumn("into", F.lit(None).cast("int")).withColumn("reason", F.lit(NO_LABEL_ON_TOP))
    return merges, alone.unionByName(whole)


def places(slots: DataFrame, cells: DataFrame) -> DataFrame:
    """slots with the facts of the cell on each place."""
    return slots.join(facts(slots, cells), [TABLE, "cell_id"])


def at_place(slots: DataFrame, row: str, col: str, id_: str) -> DataFrame:
    return slots.select(TABLE, F.col("row_idx").alias(row), F.col("col_idx").alias(col), F.col("cell_id").alias(id_))


def column_line(slots: DataFrame, cells: DataFrame, todo: DataFrame) -> DataFrame:
    """The line of a header column below the header. todo: table_uid, hmd, index and kept, the rows that are not set aside."""
    told = facts(slots, cells)
    own = todo.join(slots, TABLE).where("col_idx = index AND row_idx >= hmd").join(told.drop("n_slots", "filled"), [TABLE, "cell_id"])
    text = told.select(TABLE, F.col("cell_id").alias("child"), F.col("text").alias("child_text"))
    beside = own.withColumn("beside", F.col("index") + 1).join(at_place(slots, "row_idx", "beside", "child"), [TABLE, "row_idx", "beside"], "left").join(text, [TABLE, "child"], "left")
    parent = beside.withColumn("before", F.col("index") - 1).join(at_place(slots, "row_idx", "before", "parent"), [TABLE, "row_idx", "before"], "left")
    order = W.partitionBy(TABLE, "index").orderBy("row_idx")
    stays = F.array_contains("kept", F.col("row_idx"))
    after_aside = (F.col("row_idx") == F.col("hmd")) | ~F.array_contains("kept", F.col("row_idx") - 1)
    wide = (F.col("first_col") != F.col("index")) | (F.col("last_col") != F.col("index"))
    return parent.select(
        TABLE, F.lit("column").alias("line"), "index", F.col("row_idx").alias("pos"), "cell_id", "text", "empty", (F.col("first_row") == F.col("row_idx")).alias("begins"), F.col("last_row").alias("last"),
        F.struct("first_col", "last_col").alias("cross"), (~stays | wide).alias("stop"), ((F.col("index") == 0) | F.coalesce(F.lag("parent").over(order) == F.col("parent"), F.lit(False))).alias("joins"),
        "child", "child_text", stays.alias("counted"), (stays & after_aside).alias("top"), F.lit(True).alias("whole"), "first_row", "last_row", "first_col", "last_col",
    )


def row_line(slots: DataFrame, cells: DataFrame, todo: DataFrame) -> DataFrame:
    """The line of a header row right of the header columns. todo: table_uid, hmd, vmd, index and kept."""
    told = facts(slots, cells)
    position = F.array_position("kept", F.col("index")).cast("int")
    near = todo.withColumn("above", F.get("kept", position - 2)).withColumn("below", F.get("kept", position))
    own = near.join(slots, TABLE).where("row_idx = index AND col_idx >= vmd").join(told.drop("n_slots", "filled"), [TABLE, "cell_id"])
    text = told.select(TABLE, F.col("cell_id").alias("child"), F.col("text").alias("child_text"))
    under = own.join(at_place(slots, "below", "col_idx", "child"), [TABLE, "below", "col_idx"], "left").join(text, [TABLE, "child"], "left")
    over = under.join(at_place(slots, "above", "col_idx", "parent"), [TABLE, "above", "col_idx"], "left")
    order = W.partitionBy(TABLE, "index").orderBy("col_idx")
    return over.select(
        TABLE, F.lit("row").alias("line"), "index", F.col("col_idx").alias("pos"), "cell_id", "text", "empty", (F.col("first_col") == F.col("col_idx")).alias("begins"), F.col("last_col").alias("last"),
        F.struct(F.col("first_row").alias("first_col"), F.col("last_row").alias("last_col")).alias("cross"), ((F.col("last_row") >= F.col("hmd")) & (F.col("first_col") == F.col("col_idx"))).alias("stop"), (F.col("above").isNull() | F.coalesce(F.lag("parent").over(order) == F.col("parent"), F.lit(False))).alias("joins"),
        "child", "child_text", F.lit(True).alias("counted"), (F.col("col_idx") == F.col("vmd")).alias("top"), F.col("below").isNotNull().alias("whole"), "first_row", "last_row", "first_col", "last_col",
    )


def group_rows(slots: DataFrame, cells: DataFrame, todo: DataFrame) -> DataFrame:
    """Merges of rows that a label from column 0 groups: the other cells of its row, if all of them are blank and one row
    high. todo: table_uid, hmd and cell_id, cells over the line right of the header columns."""
    told = facts(slots, cells).drop("n_slots", "filled")
    label = todo.join(told, [TABLE, "cell_id"]).where("NOT empty AND first_row = last_row AND first_col = 0 AND first_row >= hmd").select(TABLE, F.col("first_row").alias("row"), F.col("cell_id").alias("into"))
    others = label.join(slots.withColumnRenamed("row_idx", "row"), [TABLE, "row"]).where("cell_id <> into").select(TABLE, "row", "into", "cell_id").distinct().join(told, [TABLE, "cell_id"])
    blank = F.col("empty") & (F.col("first_row") == F.col("last_row"))
    sound = others.groupBy(TABLE, "row").agg(F.bool_and(blank).alias("sound")).where("sound").select(TABLE, "row")
    return others.join(sound, [TABLE, "row"], "left_semi").select(TABLE, "cell_id", "into", F.lit("left").alias("direction"), "first_row", "last_row", "first_col", "last_col")


def merged_slots(slots: DataFrame, merges: DataFrame) -> DataFrame:
    """slots with every merge (table_uid, cell_id, into) applied, chains of merges followed to their end.

    Chains are followed by doubling: each round every merge goes where its target goes, until none goes further, so a
    chain of n takes log2(n) rounds. A circle of merges is an error."""
    ends = kept(merges.select(TABLE, "cell_id", "into").distinct())
    rounds = 0
    while True:
        on = ends.select(TABLE, F.col("cell_id").alias("into"), F.col("into").alias("further"))
        after = kept(ends.join(on, [TABLE, "into"], "left").select(TABLE, "cell_id", F.coalesce("further", "into").alias("into"), F.col("further").isNotNull().alias("moved")))
        if after.where("moved").isEmpty():
            break
        rounds += 1
        if rounds > 31:
            raise ValueError("merges go in a circle")
        ends = after.drop("moved")
    return slots.join(after.select(TABLE, "cell_id", "into"), [TABLE, "cell_id"], "left").select(TABLE, "row_idx", "col_idx", F.coalesce("into", "cell_id").alias("cell_id"))


def merged_cells(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """The cells that are left."""
    return cells.join(merges.select(TABLE, "cell_id").distinct(), [TABLE, "cell_id"], "left_anti")


def round_of(slots: DataFrame, cells: DataFrame, targets: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round for every table: slots afterwards, merges (MERGES) and refusals (REFUSED), numbered from n on: first the
    header columns that lack evidence from left to right, then the header rows from top to bottom, each on the table
    as the one before left it, then the grouped rows."""
    rest = strip_separators(slots)
    rows = rest.select(TABLE, "source_row").distinct().groupBy(TABLE).agg(F.sort_array(F.collect_list("source_row")).alias("kept"))
    named = kept(targets.join(rows, TABLE).withColumn("kept_hmd", F.size(F.filter("kept", lambda x: x < F.col("hmd")))))
    broken = witnesses(rest.drop("source_row"), named.select(TABLE, F.col("kept_hmd").alias("hmd"), "vmd")).drop("hmd", "vmd")
    todo = kept(named.join(broken.select(TABLE, "columns_3", "rows_2", "cells_0"), TABLE).withColumn("rows_2", F.transform("rows_2", lambda i: F.get("kept", i))))
    steps = todo.agg(F.max(F.size("columns_3")), F.max(F.size("rows_2"))).first()
    spark, made, refused = slots.sparkSession, [], []

    def applied(merges: DataFrame) -> DataFrame:
        made.append(merges)
        return kept(merged_slots(slots, merges))

    for listed, line, direction, many in (("columns_3", column_line, "up", steps[0] or 0), ("rows_2", row_line, "left", steps[1] or 0)):
        for k in range(many):
            part = todo.withColumn("index", F.get(listed, F.lit(k))).where("index IS NOT NULL")
            along = kept(line(slots, cells, part.select(TABLE, "hmd", "vmd", "index", "kept")))
            merges, refusals = line_merges(along)
            place = W.partitionBy(TABLE).orderBy("pos")
            told = merges.join(along.where("begins").select(TABLE, "line", "index", "cell_id", "first_row", "last_row", "first_col", "last_col"), [TABLE, "line", "index", "cell_id"])
            found = kept(told.select(TABLE, (F.row_number().over(place) + n).cast("int").alias("n"), "cell_id", "into", F.lit(direction).alias("direction"), "first_row", "last_row", "first_col", "last_col"))
            refused.append(kept(refusals.select(TABLE, (F.row_number().over(W.partitionBy(TABLE).orderBy("at")) + n).cast("int").alias("n"), "line", "index", "into", "cells", "reason")))
            n += 1_000_000
            slots = applied(found)
    groups = group_rows(slots, cells, todo.select(TABLE, "hmd", F.explode("cells_0").alias("cell_id")))
    numbered = kept(groups.withColumn("n", (F.row_number().over(W.partitionBy(TABLE).orderBy("into", "first_col")) + n).cast("int")).select(TABLE, "n", "cell_id", "into", "direction", "first_row", "last_row", "first_col", "last_col"))
    slots = applied(numbered)
    union = lambda parts, schema: spark.createDataFrame([], schema) if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:], schema))
    return slots, union(made, MERGES), union(refused, REFUSED)


def repairs(slots: DataFrame, cells: DataFrame, targets: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """How each boundary (table_uid, hmd, vmd; one for a table) can be had: results, merges and refusals.

    results: table_uid, hmd, vmd, status and matched, the kind of the candidate that has the counts then: already_offered;
    repaired; not_repaired (cells were merged, the boundary is still refused); refused (blanks could join labels, but
    without evidence); not_applicable. merges: table_uid, n (their order), cell_id, into, direction (up or left) and the
    merged cell's first and last row and column. refusals: table_uid, n, line (column or row), index, into (null for the
    whole line), cells, reason.

    Rounds go on with the tables that changed, `rounds` times at most; targets outside their table are left out.
    """
    size = slots.groupBy(TABLE).agg((F.max("row_idx") + 1).alias("n_rows"), (F.max("col_idx") + 1).alias("n_cols"))
    inside = targets.select(TABLE, "hmd", "vmd").join(size, TABLE).where("hmd BETWEEN 0 AND n_rows AND vmd BETWEEN 0 AND n_cols").drop("n_rows", "n_cols")
    active, now = kept(inside), slots
    merges, refusals, results = [], [], []
    for k in range(rounds + 1):
        now = kept(now.join(active.select(TABLE), TABLE, "left_semi"))
        matched = kept(active.join(marginal_counts(now).withColumnRenamed("kind", "matched"), [TABLE, "hmd", "vmd"]))
        results.append(matched)
        active = kept(active.join(matched.select(TABLE), TABLE, "left_anti"))
        if k == rounds or active.isEmpty():
            break
        now, new, refused = round_of(now.join(active.select(TABLE), TABLE, "left_semi"), cells, active, k * 100_000_000)
        merges.append(new)
        refusals.append(refused)
        changed = new.select(TABLE).distinct()
        active = kept(active.join(changed, TABLE, "left_semi"))
    spark = slots.sparkSession
    union = lambda parts, schema: spark.createDataFrame([], schema) if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:], schema))
    order = W.partitionBy(TABLE).orderBy("n")
    made = kept(union(merges, MERGES).withColumn("n", F.row_number().over(order)))
    every = union(refusals, REFUSED)
    again = W.partitionBy(TABLE, "line", "index", "into", "cells", "reason").orderBy("n")
    once = kept(every.withColumn("k", F.row_number().over(again)).where("k = 1").withColumn("n", F.row_number().over(order)).drop("k"))
    found = union(results, "table_uid string, hmd int, vmd int, matched string")
    mark = lambda d, name: d.select(TABLE).distinct().withColumn(name, F.lit(True))
    joined = inside.join(found.select(TABLE, "matched"), TABLE, "left").join(mark(made, "made"), TABLE, "left").join(mark(once, "held"), TABLE, "left")
    status = F.when(F.col("matched").isNotNull(), F.when(F.col("made"), "repaired").otherwise("already_offered")).when(F.col("made"), "not_repaired").when(F.col("held"), "refused").otherwise("not_applicable")
    return joined.select(TABLE, "hmd", "vmd", status.alias("status"), "matched"), made, once


def recheck(stored: DataFrame, made: DataFrame) -> DataFrame:
    """Tables whose stored merges (table_uid, cell_id, into, direction, rows and columns) are not those made, with the
    numbers of merges that only one has."""
    columns = [TABLE, "cell_id", "into", "direction", "first_row", "last_row", "first_col", "last_col"]
    apart = differences(stored.select(*columns), made.select(*columns))
    return apart.groupBy(TABLE).agg(F.count_if(F.col("side") == "stored").alias("only_stored"), F.count_if(F.col("side") == "computed").alias("only_made"))


def decided_by_repair(decided: DataFrame, results: DataFrame) -> DataFrame:
    """Decisions (table_uid, final_status, candidate_id) with unparseable ones made valid where the answered boundary was
    repaired; decided_by answer or repair, the candidate being <table_uid>/repaired/h<hmd>_v<vmd>."""
    mended = results.where("status = 'repaired'").select(TABLE, F.concat(F.lit("repaired/h"), F.col("hmd").cast("string"), F.lit("_v"), F.col("vmd").cast("string")).alias("mended"))
    found = decided.join(mended, TABLE, "left")
    by: Column = (F.col("final_status") == "unparseable") & F.col("mended").isNotNull()
    return found.select(TABLE, F.when(by, "valid").otherwise(F.col("final_status")).alias("final_status"), F.when(by, F.col("mended")).otherwise(F.col("candidate_id")).alias("candidate_id"), F.when(by, "repair").otherwise("answer").alias("decided_by"))
