"""Readings of a table with rows set aside and with headers in the middle.

A layout is a list of subtables, each a set of rows and columns with its own number of header rows and columns, and
of rows set aside. Layouts are found by cutting data regions: above a row with a cell over several columns, or left of
a column with a cell over several rows. All tables are cut at once, one region of every reading a round.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.operators.geometry import TABLE, boundaries, separators, slots_to_raster, strip_separators
from tablewright.sources.shared import kept, kept_by_table  # noqa: F401

#: Layouts with cuts that a table has at most, and readings that are followed for one boundary.
MOST, FOLLOWED = 16, 64

INTS = "array<int>"
OPTIONS = "array<struct<kind: string, at: int, n: int>>"
SEPARATORS = "array<struct<row_idx: int, columns: array<int>>>"
_names = count()


def span(first: str, last: str) -> str:
    """The whole numbers from first to last; none if last is smaller."""
    return f"(CASE WHEN {first} <= {last} THEN sequence({first}, {last}) ELSE cast(array() AS {INTS}) END)"


def view(rows: str, columns: str) -> str:
    """The places of `raster` at the given rows and columns."""
    r, c = (f"x{next(_names)}" for _ in range(2))
    return f"transform({rows}, {r} -> transform({columns}, {c} -> raster[{r}][{c}]))"


def valid(rows: str, columns: str, h: str, v: str) -> str:
    """Whether a piece reads with h header rows and v header columns under all rules but the one that wants header
    rows wherever cells are merged."""
    b, i, j = (f"x{next(_names)}" for _ in range(3))
    n, m = f"size({b})", f"size({b}[0])"
    same_right, same_below = f"{b}[{i}][{j}] = {b}[{i}][{j} + 1]", f"{b}[{i}][{j}] = {b}[{i} + 1][{j}]"
    next_right, next_below = f"{b}[{i}][{j} + 1] = {b}[{i} + 1][{j} + 1]", f"{b}[{i} + 1][{j}] = {b}[{i} + 1][{j} + 1]"
    head_rows, head_columns = span("0", f"{h} - 2"), span("0", f"{v} - 2")
    right, below = span(v, f"{m} - 2"), span(h, f"{n} - 2")
    tests = [
        f"{h} + {v} > 0 AND {h} < {n} AND {v} < {m}",
        f"({v} = 0 OR NOT exists({span(h, f'{n} - 1')}, {i} -> {b}[{i}][{v} - 1] = {b}[{i}][{v}]))",
        f"({h} = 0 OR NOT exists({span('0', f'{m} - 1')}, {j} -> {b}[{h} - 1][{j}] = {b}[{h}][{j}]))",
        f"forall({head_rows}, {i} -> exists({right}, {j} -> {same_right} AND NOT {next_below}))",
        f"forall({head_columns}, {j} -> exists({below}, {i} -> {same_below} AND NOT {next_right}))",
        f"NOT exists({head_rows}, {i} -> exists({right}, {j} -> NOT {same_right} AND {next_below}))",
        f"NOT exists({head_columns}, {j} -> exists({span(f'greatest(0, {h} - 1)', f'{n} - 2')}, {i} -> NOT {same_below} AND {next_right}))",
        f"({h} = 0 OR NOT exists({span(f'greatest(0, {v} - 1)', f'{m} - 2')}, {j} -> {b}[{h} - 1][{j}] = {b}[{h} - 1][{j} + 1]))",
    ]
    return f"exists(array({view(rows, columns)}), {b} -> {' AND '.join(tests)})"


def one_cell(row: str, columns: str) -> str:
    c = f"x{next(_names)}"
    return f"(size({columns}) > 1 AND forall({columns}, {c} -> raster[{row}][{c}] = raster[{row}][{columns}[0]]))"


def set_aside(rows: str, columns: str) -> str:
    """The rows of a data region that one cell covers."""
    r = f"x{next(_names)}"
    return f"filter({rows}, {r} -> {one_cell(r, columns)})"


def has_data(rows: str, columns: str) -> str:
    r = f"x{next(_names)}"
    return f"exists({rows}, {r} -> NOT {one_cell(r, columns)})"


def options(heads: str, sides: str, rows: str, columns: str, kinds: str) -> str:
    """The cuts that a data region (rows x columns, under the rows `heads` and beside the columns `sides`) can begin
    with: kind, the number of rows (columns) before the cut, and that of the header rows (columns) after it. Both pieces
    must read alone and once they are fused with the headers around them, and hold data."""
    at, n, r, c = (f"x{next(_names)}" for _ in range(4))
    wide, tall = f"concat({sides}, {columns})", f"concat({heads}, {rows})"
    before, after = f"slice({rows}, 1, {at})", f"slice({rows}, {at} + 1, size({rows}))"
    data = f"slice({rows}, {at} + {n} + 1, size({rows}))"
    line = f"NOT exists({columns}, {c} -> raster[{rows}[{at} - 1]][{c}] = raster[{rows}[{at}]][{c}]) AND exists({span('1', f'size({columns}) - 1')}, {c} -> raster[{rows}[{at}]][{columns}[{c} - 1]] = raster[{rows}[{at}]][{columns}[{c}]])"
    fits = [valid(after, columns, n, "0"), valid(after, wide, n, f"size({sides})"), valid(f"concat({heads}, {before})", wide, f"size({heads})", f"size({sides})"), has_data(before, columns), has_data(data, columns)]
    across = f"flatten(transform(filter({span('1', f'size({rows}) - 1')}, {at} -> {line}), {at} -> transform(filter({span('1', f'size({rows}) - {at} - 1')}, {n} -> {' AND '.join(fits)}), {n} -> named_struct('kind', 'h', 'at', {at}, 'n', {n}))))"
    left, right = f"slice({columns}, 1, {at})", f"slice({columns}, {at} + 1, size({columns}))"
    data = f"slice({columns}, {at} + {n} + 1, size({columns}))"
    line = f"NOT exists({rows}, {r} -> raster[{r}][{columns}[{at} - 1]] = raster[{r}][{columns}[{at}]]) AND exists({span('1', f'size({rows}) - 1')}, {r} -> raster[{rows}[{r} - 1]][{columns}[{at}]] = raster[{rows}[{r}]][{columns}[{at}]])"
    fits = [valid(rows, right, "0", n), valid(tall, right, f"size({heads})", n), valid(tall, f"concat({sides}, {left})", f"size({heads})", f"size({sides})"), has_data(rows, left), has_data(rows, data)]
    down = f"flatten(transform(filter({span('1', f'size({columns}) - 1')}, {at} -> {line}), {at} -> transform(filter({span('1', f'size({columns}) - {at} - 1')}, {n} -> {' AND '.join(fits)}), {n} -> named_struct('kind', 'v', 'at', {at}, 'n', {n}))))"
    some = lambda kind, found: f"(CASE WHEN {kinds} LIKE '%{kind}%' THEN {found} ELSE cast(array() AS {OPTIONS}) END)"
    return f"cast(concat({some('h', across)}, {some('v', down)}) AS {OPTIONS})"


def region(name: str, heads: str, sides: str, rows: str, columns: str, kinds: str):
    """A function that adds the region `name` (heads, sides, rows without those set aside, columns and options) and
    `name`_aside to its input."""

    def add(df: DataFrame) -> DataFrame:
        df = df.selectExpr("*", f"{heads} AS _heads", f"{sides} AS _sides", f"{rows} AS _rows", f"{columns} AS _columns")
        df = df.selectExpr("*", f"{set_aside('_rows', '_columns')} AS _aside").withColumn("_rows", F.array_except("_rows", "_aside"))
        df = df.selectExpr("*", f"{options('_heads', '_sides', '_rows', '_columns', kinds)} AS _options")
        aside = F.transform("_aside", lambda r: F.struct(r.alias("row_idx"), F.concat("_sides", "_columns").alias("columns")))
        made = F.struct(F.col("_heads").alias("heads"), F.col("_sides").alias("sides"), F.col("_rows").alias("rows"), F.col("_columns").alias("columns"), F.col("_options").alias("options"))
        return df.select("*", made.alias(name), aside.cast(SEPARATORS).alias(f"{name}_aside")).drop("_heads", "_sides", "_rows", "_columns", "_aside", "_options")

    return add


def cut_once(readings: DataFrame) -> DataFrame:
    """Every reading with its first undecided region decided in all ways: each of its options, or left whole."""
    at = readings.selectExpr("*", "array_position(transform(regions, r -> size(r.options) > 0), true) AS p").selectExpr("*", "get(regions, p - 1) AS q")
    none = F.struct(F.lit("none").alias("kind"), F.lit(0).alias("at"), F.lit(0).alias("n"))
    chosen = at.select("*", F.posexplode(F.concat("q.options", F.array(none))).alias("choice", "o"))
    whole = chosen.where("o.kind = 'none'").selectExpr("*", f"named_struct('heads', q.heads, 'sides', q.sides, 'rows', q.rows, 'columns', q.columns, 'options', cast(array() AS {OPTIONS})) AS one").withColumn("made", F.array("one")).withColumn("new_aside", F.array().cast(SEPARATORS)).drop("one")
    cut = chosen.where("o.kind <> 'none'")
    rows, columns = "o.kind = 'h'", "o.kind = 'v'"
    cut = region("first", "q.heads", "q.sides", f"CASE WHEN {rows} THEN slice(q.rows, 1, o.at) ELSE q.rows END", f"CASE WHEN {columns} THEN slice(q.columns, 1, o.at) ELSE q.columns END", f"CASE WHEN {rows} THEN 'v' ELSE 'h' END")(cut)
    cut = region(
        "second", f"CASE WHEN {rows} THEN slice(q.rows, o.at + 1, o.n) ELSE q.heads END", f"CASE WHEN {columns} THEN slice(q.columns, o.at + 1, o.n) ELSE q.sides END",
        f"CASE WHEN {rows} THEN slice(q.rows, o.at + o.n + 1, size(q.rows)) ELSE q.rows END", f"CASE WHEN {columns} THEN slice(q.columns, o.at + o.n + 1, size(q.columns)) ELSE q.columns END", "'hv'",
    )(cut)
    cut = cut.withColumn("made", F.array("first", "second")).withColumn("new_aside", F.concat("first_aside", "second_aside")).drop("first", "second", "first_aside", "second_aside")
    both = whole.unionByName(cut)
    placed = F.concat(F.slice("regions", F.lit(1), F.col("p") - 1), F.col("made"), F.slice("regions", F.col("p") + 1, F.size("regions")))
    return both.select(TABLE, "raster", "top", "hmd", "vmd", F.concat("choices", F.array("choice")).alias("choices"), placed.alias("regions"), F.concat("separators", "new_aside").alias("separators"))


def table_layouts(slots: DataFrame) -> DataFrame:
    """Every layout: table_uid, ord (from 0), hmd and vmd of the boundary it begins with, separators array<struct<
    row_idx, columns>> and subtables array<struct<rows, columns, hmd, vmd>>, in rows and columns of the table.

    Rows that one cell covers are set aside, and the boundaries of the rest are the marginal layouts, the last ones,
    with rows that one cell covers over all data columns set aside too. Before them come at most 16 layouts with cuts,
    those with most cuts first, then by boundary and by the order of the cuts (upper and left ones first, across before
    down); of layouts that label all places alike the first counts, and of one boundary the first 64 readings. A table
    without a boundary has none.

    Each round decides one region of every reading that has one left, in columns of one row, and ranks the readings of a
    boundary to follow 64; the readings are written between rounds. Only tables with a possible cut take part.
    """
    aside = separators(slots)
    rest = slots.join(aside, [TABLE, "row_idx"], "left_anti")
    lines = rest.groupBy(TABLE).agg(F.sort_array(F.collect_set("row_idx")).alias("rows"), F.sort_array(F.collect_set("col_idx")).alias("columns"))
    top = aside.groupBy(TABLE).agg(F.sort_array(F.collect_list("row_idx")).alias("top"))
    found = boundaries(strip_separators(slots).drop("source_row")).join(lines, TABLE).join(top, TABLE, "left").join(slots_to_raster(slots), TABLE)
    begun = found.withColumn("top", F.coalesce("top", F.array().cast(INTS)))
    begun = region("whole", "slice(rows, 1, hmd)", "slice(columns, 1, vmd)", "slice(rows, hmd + 1, size(rows))", "slice(columns, vmd + 1, size(columns))", "'hv'")(begun)
    begun = kept_by_table(begun.where("size(whole.rows) > 0").select(TABLE, "raster", "top", "hmd", "vmd", F.array().cast(INTS).alias("choices"), F.array("whole").alias("regions"), F.col("whole_aside").alias("separators")))

    undecided = "exists(regions, r -> size(r.options) > 0)"
    order = F.row_number().over(W.partitionBy(TABLE, "hmd", "vmd").orderBy("choices"))
    readings = kept_by_table(cut_once(begun.where(undecided)).where("size(regions) > 1"))
    while not readings.where(undecided).isEmpty():
        more = readings.where(f"NOT {undecided}").unionByName(cut_once(readings.where(undecided)))
        readings = kept_by_table(more.withColumn("n", order).where(F.col("n") <= FOLLOWED).drop("n"))

    central = finished(readings.withColumn("n", order).where(F.col("n") <= FOLLOWED).drop("n")).withColumn("labels", painted())
    first = F.row_number().over(W.partitionBy(TABLE, "labels").orderBy("hmd", "vmd", "choices"))
    distinct = central.withColumn("n", first).where("n = 1")
    most = F.row_number().over(W.partitionBy(TABLE).orderBy(F.size("subtables").desc(), "hmd", "vmd", "choices"))
    marginal = finished(begun)
    last = F.row_number().over(W.partitionBy(TABLE).orderBy("marginal", F.when(~F.col("marginal"), -F.size("subtables")), "hmd", "vmd", "choices")) - 1
    told = lambda df, is_marginal: df.select(TABLE, "hmd", "vmd", "choices", "separators", "subtables", F.lit(is_marginal).alias("marginal"))
    both = kept_by_table(told(distinct.withColumn("n", most).where(F.col("n") <= MOST), False), told(marginal, True))
    return both.withColumn("ord", last).select(TABLE, "ord", "hmd", "vmd", "separators", "subtables")


def finished(readings: DataFrame) -> DataFrame:
    """Readings as layouts, their separators in order of rows and columns."""
    width = F.size(F.col("raster")[0])
    whole = F.transform("top", lambda r: F.struct(r.alias("row_idx"), F.sequence(F.lit(0), width - 1).alias("columns")))
    subtables = F.transform("regions", lambda r: F.struct(F.concat(r["heads"], r["rows"]).alias("rows"), F.concat(r["sides"], r["columns"]).alias("columns"), F.size(r["heads"]).alias("hmd"), F.size(r["sides"]).alias("vmd")))
    return readings.select(TABLE, "raster", "hmd", "vmd", "choices", F.sort_array(F.concat(whole, "separators")).cast(SEPARATORS).alias("separators"), subtables.alias("subtables"))


def painted():
    """The label of every place of a layout, a letter each (s, h, v, d), rows one below the other."""
    role = "CASE WHEN array_position(s.rows, r) <= s.hmd THEN 'h' WHEN array_position(s.columns, c) <= s.vmd THEN 'v' ELSE 'd' END"
    held = f"element_at(transform(filter(subtables, s -> array_contains(s.rows, r) AND array_contains(s.columns, c)), s -> {role}), 1)"
    place = f"CASE WHEN exists(separators, x -> x.row_idx = r AND array_contains(x.columns, c)) THEN 's' ELSE {held} END"
    return F.expr(f"transform(sequence(0, size(raster) - 1), r -> array_join(transform(sequence(0, size(raster[0]) - 1), c -> {place}), ''))")


def table_candidates(slots: DataFrame) -> DataFrame:
    """Layouts as candidates: table_uid, ord, candidate_id, kind, hmd, vmd, separators and subtables. A plain boundary,
    without separators or cuts, is h<hmd>_v<vmd>; the others are layout<k>, counted from 1 in their order."""
    found = table_layouts(slots).withColumn("kind", F.when((F.size("separators") == 0) & (F.size("subtables") == 1), "boundary").otherwise("layout"))
    k = F.row_number().over(W.partitionBy(TABLE, "kind").orderBy("ord"))
    name = F.when(F.col("kind") == "layout", F.concat(F.lit("layout"), k.cast("string"))).otherwise(F.concat(F.lit("h"), F.col("hmd").cast("string"), F.lit("_v"), F.col("vmd").cast("string")))
    return found.select(TABLE, "ord", name.alias("candidate_id"), "kind", "hmd", "vmd", "separators", "subtables")


def roles(slots: DataFrame, candidates: DataFrame) -> DataFrame:
    """(table_uid, candidate_id, k, row_idx, col_idx, role, cell_id): the places of every subtable k, hmd, vmd or data, and
    those set aside, with k -1. A place in several subtables comes once for each."""
    rows = candidates.select(TABLE, "candidate_id", F.posexplode("subtables").alias("k", "s")).select(TABLE, "candidate_id", "k", "s.hmd", "s.vmd", "s.columns", F.posexplode("s.rows").alias("r", "row_idx"))
    role = F.when(F.col("r") < F.col("hmd"), "hmd").when(F.col("c") < F.col("vmd"), "vmd").otherwise("data")
    places = rows.select(TABLE, "candidate_id", "k", "row_idx", "r", "hmd", "vmd", F.posexplode("columns").alias("c", "col_idx")).select(TABLE, "candidate_id", "k", "row_idx", "col_idx", role.alias("role"))
    aside = candidates.select(TABLE, "candidate_id", F.explode("separators").alias("x")).select(TABLE, "candidate_id", F.lit(-1).alias("k"), "x.row_idx", F.explode("x.columns").alias("col_idx"), F.lit("separator").alias("role"))
    return places.unionByName(aside).join(slots, [TABLE, "row_idx", "col_idx"])


def partition_checks(slots: DataFrame, candidates: DataFrame) -> DataFrame:
    """How a layout's subtables and rows set aside part a table: table_uid, candidate_id, uncovered places, places that
    are set aside and in a subtable or twice set aside (overlapping), places with several roles (disagreeing), data
    places in several subtables (shared), cells with several roles, and data cells in several subtables; all 0 for a
    sound layout."""
    held = roles(slots, candidates)
    every = candidates.select(TABLE, "candidate_id").join(slots, TABLE).join(held.drop("cell_id"), [TABLE, "candidate_id", "row_idx", "col_idx"], "left")
    aside, data = F.col("role") == "separator", F.col("role") == "data"
    of_place = every.groupBy(TABLE, "candidate_id", "row_idx", "col_idx").agg(F.count("role").alias("n"), F.count_if(aside).alias("aside"), F.countDistinct("role").alias("roles"), F.count_if(data).alias("data"))
    of_place = of_place.groupBy(TABLE, "candidate_id").agg(
        F.count_if(F.col("n") == 0).alias("uncovered"), F.count_if((F.col("aside") > 0) & (F.col("n") > 1)).alias("overlapping"),
        F.count_if((F.col("roles") > 1) & (F.col("aside") == 0)).alias("disagreeing"), F.count_if((F.col("data") > 0) & (F.col("n") > 1) & (F.col("aside") == 0)).alias("shared"),
    )
    of_cell = every.groupBy(TABLE, "candidate_id", "cell_id").agg(F.countDistinct("role").alias("roles"), F.countDistinct(F.when(data, F.col("k"))).alias("homes"))
    of_cell = of_cell.groupBy(TABLE, "candidate_id").agg(F.count_if(F.col("roles") > 1).alias("several_roles"), F.count_if(F.col("homes") > 1).alias("split_data"))
    return of_place.join(of_cell, [TABLE, "candidate_id"])


def cell_labels(held: DataFrame) -> DataFrame:
    """(table_uid, candidate_id, cell_id, region): a cell has the role of its first place. held: as of roles."""
    return held.groupBy(TABLE, "candidate_id", "cell_id").agg(F.min_by("role", F.struct("row_idx", "col_idx")).alias("region"))


def subtable_lines(held: DataFrame) -> DataFrame:
    """The lines of each subtable, for scoring: table_uid, candidate_id, axis, line (struct of the subtable and the data
    column or row, 0 for its header rows and columns) and cell_id, once a line, if the cell's label is that of the place."""
    named = held.where("k >= 0").join(cell_labels(held), [TABLE, "candidate_id", "cell_id"]).where("role = region")
    axis = lambda name, at, test: named.where(test).select(TABLE, "candidate_id", F.lit(name).alias("axis"), F.struct("k", at.alias("at")).alias("line"), "cell_id")
    data = F.col("role") == "data"
    return axis("col", F.col("col_idx"), data).unionByName(axis("row", F.col("row_idx"), data)).unionByName(axis("hmd", F.lit(0), F.col("role") == "hmd")).unionByName(axis("vmd", F.lit(0), F.col("role") == "vmd")).distinct()


def complexity(candidates: DataFrame) -> DataFrame:
    """The class of a table by its most complex candidate: subtables, separator_rows, multi_level or simple."""
    grade = F.max(F.when(F.size("subtables") > 1, 3).when(F.size("separators") > 0, 2).when(F.exists("subtables", lambda s: (s["hmd"] > 1) | (s["vmd"] > 1)), 1).otherwise(0))
    return candidates.groupBy(TABLE).agg(grade.alias("grade")).select(TABLE, F.element_at(F.array(*[F.lit(x) for x in ("simple", "multi_level", "separator_rows", "subtables")]), F.col("grade") + 1).alias("class"))


def as_tables(slots: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subtables as tables of their own, for the operators on tables: slots with table_uid <uid>#<candidate_id>#<k> and rows
    and columns counted anew, and their boundaries (table_uid, hmd, vmd)."""
    parts = candidates.select(TABLE, "candidate_id", F.posexplode("subtables").alias("k", "s")).withColumn("uid", F.concat_ws("#", TABLE, "candidate_id", "k"))
    rows = parts.select(TABLE, "uid", "s.columns", F.posexplode("s.rows").alias("r", "row_idx"))
    places = rows.select(TABLE, "uid", "r", "row_idx", F.posexplode("columns").alias("c", "col_idx")).join(slots, [TABLE, "row_idx", "col_idx"])
    return places.select(F.col("uid").alias(TABLE), F.col("r").alias("row_idx"), F.col("c").alias("col_idx"), "cell_id"), parts.select(F.col("uid").alias(TABLE), "s.hmd", "s.vmd")


def layout_labels(slots: DataFrame, candidates: DataFrame) -> DataFrame:
    """(table_uid, candidate_id, labels array<string>): a letter for every place, s, h, v or d, a string for each row."""
    wide = candidates.select(TABLE, "candidate_id", "separators", "subtables").join(slots_to_raster(slots), TABLE)
    return wide.select(TABLE, "candidate_id", painted().alias("labels"))
