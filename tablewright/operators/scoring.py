"""Description lengths and purities of candidates by cell types, and the choice of one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.operators.rules import IGNORED

TABLE = "table_uid"
#: Scores this close are ties.
TIE = 1e-9


def lines(slots: DataFrame, labels: DataFrame, header_model: str = "region") -> DataFrame:
    """(table_uid, candidate_id, axis, line, cell_id): cells of each data column (col), each data row (row), and of
    all header rows (hmd) and header columns (vmd), once for each line they cover. By the header model `line` every
    header row and header column is a line of its own, and a cell over several of them counts in each. Of candidates with
    several subtables layouts.subtable_lines gives the lines, which the costs and purities below take just as well."""
    places = slots.groupBy(TABLE, "cell_id").agg(F.collect_set("row_idx").alias("rows"), F.collect_set("col_idx").alias("cols"))
    at = labels.where("region IN ('data', 'hmd', 'vmd')").select(TABLE, "candidate_id", "cell_id", "region").join(places, [TABLE, "cell_id"], "left")
    line = lambda axis, values: F.transform(values, lambda x: F.struct(F.lit(axis).alias("axis"), x.alias("line")))
    heads = F.array(F.struct(F.col("region").alias("axis"), F.lit(0).alias("line")))
    if header_model == "line":
        heads = F.when(F.col("region") == "hmd", line("hmd", F.col("rows"))).otherwise(line("vmd", F.col("cols")))
    each = F.when(F.col("region") == "data", F.concat(line("col", F.col("cols")), line("row", F.col("rows")))).otherwise(heads)
    return at.select(TABLE, "candidate_id", "cell_id", F.inline(each)).select(TABLE, "candidate_id", "axis", "line", "cell_id")


def line_counts(found: DataFrame, cell_types: DataFrame, level: str = "family", roles: tuple[str, ...] = ()) -> DataFrame:
    """k cells of each type and n of all types on each line. Cells whose family is empty, untyped or Missing are
    left out, as are cells of a role from data rows."""
    role = F.col("family").isin(*roles) | F.col("type").isin(*roles) if roles else F.lit(False)
    types = cell_types.where(~F.col("family").isin(*IGNORED)).select(TABLE, "cell_id", F.col(level).alias("kind"), role.alias("role"))
    counted = found.join(types, [TABLE, "cell_id"]).where(~((F.col("axis") == "row") & F.col("role")))
    per = counted.groupBy(TABLE, "candidate_id", "axis", "line", "kind").agg(F.count("*").alias("k"))
    return per.withColumn("n", F.sum("k").over(W.partitionBy(TABLE, "candidate_id", "axis", "line")))


def bit_costs(found: DataFrame, cell_types: DataFrame, level: str = "family", roles: tuple[str, ...] = (), model_cost: bool = True) -> DataFrame:
    """(table_uid, candidate_id, bits): (columns + rows) / 2 + header rows + header columns, each distribution with
    n typed cells costing n times its entropy and half the logarithm of the table's typed cells, which is also
    the cost of every role cell among the header columns."""
    counts = line_counts(found, cell_types, level, roles)
    typed = cell_types.where(~F.col("family").isin(*IGNORED)).groupBy(TABLE).agg(F.count("*").alias("n_typed"))
    unit = 0.5 * F.log2(F.greatest(F.col("n_typed"), F.lit(2)))
    line = counts.groupBy(TABLE, "candidate_id", "axis", "line").agg(F.sum(-F.col("k") * F.log2(F.col("k") / F.col("n"))).alias("bits"))
    weight = F.when(F.col("axis").isin("col", "row"), 0.5).otherwise(1.0)
    cost = line.join(typed, TABLE).groupBy(TABLE, "candidate_id").agg(F.sum(weight * (F.col("bits") + (unit if model_cost else 0.0))).alias("bits"))
    every = found.select(TABLE, "candidate_id").distinct()
    if roles:
        misplaced = found.where("axis = 'vmd'").join(cell_types.where(F.col("family").isin(*roles) | F.col("type").isin(*roles)).select(TABLE, "cell_id"), [TABLE, "cell_id"])
        extra = misplaced.groupBy(TABLE, "candidate_id").agg(F.countDistinct("cell_id").alias("m")).join(typed, TABLE).select(TABLE, "candidate_id", (F.col("m") * unit).alias("extra"))
        cost = cost.join(extra, [TABLE, "candidate_id"], "left").select(TABLE, "candidate_id", (F.col("bits") + F.coalesce("extra", F.lit(0.0))).alias("bits"))
    return every.join(cost, [TABLE, "candidate_id"], "left").select(TABLE, "candidate_id", F.coalesce("bits", F.lit(0.0)).alias("bits"))


def boundary_costs(slots: DataFrame, candidates: DataFrame, cell_types: DataFrame, level: str = "family", roles: tuple[str, ...] = (), model_cost: bool = True, header_model: str = "region") -> DataFrame:
    """bit_costs of plain boundaries (table_uid, candidate_id, hmd, vmd) straight from places and types, without labels
    and lines of every candidate: cells meet a table's candidates once, and their lines are counted as they come.

    Everything is done by table: of slots and types that are dealt by it nothing is dealt again. n log n - sum(k log k) is the
    entropy of a line with k cells of each kind and n together.
    """
    role = F.col("family").isin(*roles) | F.col("type").isin(*roles) if roles else F.lit(False)
    typed = cell_types.where(~F.col("family").isin(*IGNORED)).select(TABLE, "cell_id", F.col(level).alias("kind"), role.alias("role"))
    by_cell = slots.groupBy(TABLE, "cell_id").agg(F.min(F.struct("row_idx", "col_idx")).alias("top"), F.collect_set("row_idx").alias("rows"), F.collect_set("col_idx").alias("cols"))
    known = by_cell.join(typed, [TABLE, "cell_id"])
    found = candidates.select(TABLE, "candidate_id", "hmd", "vmd")
    at = known.join(found, TABLE)
    region = F.when(F.col("top.row_idx") < F.col("hmd"), "hmd").when(F.col("top.col_idx") < F.col("vmd"), "vmd").otherwise("data")
    line = lambda axis, values: F.transform(values, lambda x: F.struct(F.lit(axis).alias("axis"), x.alias("line")))
    rows = F.when(F.col("role"), F.array().cast("array<struct<axis:string,line:int>>")).otherwise(line("row", F.col("rows")))
    heads = F.array(F.struct(region.alias("axis"), F.lit(0).alias("line")))
    if header_model == "line":
        heads = F.when(region == "hmd", line("hmd", F.col("rows"))).otherwise(line("vmd", F.col("cols")))
    lines = F.when(region == "data", F.concat(line("col", F.col("cols")), rows)).otherwise(heads)
    each = at.select(TABLE, "candidate_id", "kind", F.explode(lines).alias("l"))
    per = each.groupBy(TABLE, "candidate_id", "l", "kind").agg(F.count("*").alias("k"))
    n = F.sum("k")
    entropy = per.groupBy(TABLE, "candidate_id", "l").agg((n * F.log2(n) - F.sum(F.col("k") * F.log2("k"))).alias("bits"))
    weight = F.when(F.col("l.axis").isin("col", "row"), 0.5).otherwise(1.0)
    cost = entropy.groupBy(TABLE, "candidate_id").agg(F.sum(weight * F.col("bits")).alias("bits"), F.sum(weight).alias("lines"))
    units = known.groupBy(TABLE).agg((0.5 * F.log2(F.greatest(F.count("*"), F.lit(2)))).alias("unit"))
    out = found.join(cost, [TABLE, "candidate_id"], "left").join(units, TABLE, "left")
    bits = F.col("bits") + (F.col("lines") * F.col("unit") if model_cost else F.lit(0.0))
    if roles:
        misplaced = at.where(F.col("role") & (region == "vmd")).groupBy(TABLE, "candidate_id").agg(F.count("*").alias("m"))
        out = out.join(misplaced, [TABLE, "candidate_id"], "left")
        bits = bits + F.coalesce(F.col("m") * F.col("unit"), F.lit(0.0))
    return out.select(TABLE, "candidate_id", F.coalesce(bits, F.lit(0.0)).alias("bits"))


def purities(found: DataFrame, cell_types: DataFrame, level: str = "family") -> DataFrame:
    """Column, row and overall purity of candidates: the mean over lines of the share of a line's commonest type,
    overall the mean of the views that have lines, 0 without any."""
    counts = line_counts(found.where("axis IN ('col', 'row')"), cell_types, level)
    line = counts.groupBy(TABLE, "candidate_id", "axis", "line").agg((F.max("k") / F.max("n")).alias("purity"))
    views = line.groupBy(TABLE, "candidate_id").agg(F.avg(F.when(F.col("axis") == "col", F.col("purity"))).alias("column_purity"), F.avg(F.when(F.col("axis") == "row", F.col("purity"))).alias("row_purity"))
    both = F.coalesce((F.col("column_purity") + F.col("row_purity")) / 2, "column_purity", "row_purity", F.lit(0.0))
    return found.select(TABLE, "candidate_id").distinct().join(views, [TABLE, "candidate_id"], "left").withColumn("purity", both)


def select(scored: DataFrame, candidates: DataFrame, lowest: bool = True) -> DataFrame:
    """One candidate per table: selected_candidate_id, status, selected_by, gap to the runner-up and n_tied.

    scored: table_uid, candidate_id, score. Ties within 1e-9 are broken by the steps from one header row and one
    header column, then the number of subtables, then the id.
    """
    sign = 1 if lowest else -1
    subtables = F.col("n_subtables") if "n_subtables" in candidates.columns else F.lit(1)
    all_ = scored.join(candidates.select(TABLE, "candidate_id", (F.abs(F.col("hmd") - 1) + F.abs(F.col("vmd") - 1)).alias("steps"), subtables.alias("subtables")), [TABLE, "candidate_id"])
    table = W.partitionBy(TABLE)
    ranked = all_.withColumn("key", sign * F.col("score")).withColumn("least", F.min("key").over(table)).withColumn("n", F.count("*").over(table))
    ranked = ranked.withColumn("tied", F.col("key") - F.col("least") <= TIE)
    order = table.orderBy(F.col("tied").desc(), "steps", "subtables", "candidate_id")
    ranked = ranked.withColumn("pick", F.row_number().over(order)).withColumn("n_tied", F.sum(F.col("tied").cast("int")).over(table))
    second = ranked.withColumn("place", F.row_number().over(table.orderBy("key", "candidate_id")))
    gap = F.max(F.when(F.col("place") == 2, F.col("key") - F.col("least"))).alias("gap")
    return second.groupBy(TABLE).agg(
        F.max(F.when(F.col("pick") == 1, F.col("candidate_id"))).alias("selected_candidate_id"), F.max("n").alias("n_candidates"), F.max("n_tied").alias("n_tied"), gap,
    ).select(
        TABLE, "selected_candidate_id", F.when(F.col("n_candidates") == 1, "unique").otherwise("selected").alias("status"),
        F.when(F.col("n_candidates") == 1, "only_candidate").when(F.col("n_tied") > 1, "tie_break").otherwise("score").alias("selected_by"), "gap", "n_tied",
    )


def margins(selected: DataFrame, cell_types: DataFrame) -> DataFrame:
    """The gap in bits per typed cell of the table, 0 without typed cells; null without a runner-up."""
    typed = cell_types.groupBy(TABLE).agg(F.count_if(~F.col("family").isin(*IGNORED)).alias("n_typed"))
    return selected.join(typed, TABLE, "left").select(TABLE, F.when(F.col("gap").isNotNull(), F.coalesce(F.try_divide("gap", "n_typed"), F.lit(0.0))).alias("margin"))


def selections(tables: DataFrame, scored: DataFrame, candidates: DataFrame, cell_types: DataFrame, scorer: str = "bit-cost") -> DataFrame:
    """The selection record of every table, by description length (`bit-cost`) or `purity`: status no_candidates, unique or
    selected; selected_candidate_id and selected_by; margin, in bits per typed cell or as a difference of purities, null
    without a runner-up; scores, an array of (candidate_id, score) by header rows and columns, empty unless there was a choice."""
    chosen = select(scored, candidates, lowest=scorer == "bit-cost")
    margin = margins(chosen, cell_types) if scorer == "bit-cost" else chosen.select(TABLE, F.col("gap").alias("margin"))
    placed = scored.join(candidates.select(TABLE, "candidate_id", "hmd", "vmd"), [TABLE, "candidate_id"])
    listed = placed.groupBy(TABLE).agg(F.sort_array(F.collect_list(F.struct("hmd", "vmd", "candidate_id", "score"))).alias("all"))
    scores = F.when(F.size("all") > 1, F.transform("all", lambda s: F.struct(s["candidate_id"].alias("candidate_id"), s["score"].alias("score"))))
    known = chosen.join(margin, TABLE).join(listed.select(TABLE, scores.alias("scores")), TABLE)
    none = F.array().cast("array<struct<candidate_id: string, score: double>>")
    out = tables.select(TABLE).distinct().join(known, TABLE, "left")
    return out.select(TABLE, F.coalesce("status", F.lit("no_candidates")).alias("status"), "selected_candidate_id", "selected_by", "margin", F.coalesce("scores", none).alias("scores"))


def abstaining(selected: DataFrame) -> DataFrame:
    """The choice, null where several candidates tie for the best score."""
    return selected.select(TABLE, F.when(F.col("n_tied") == 1, F.col("selected_candidate_id")).alias("selected_candidate_id"))


def prior_choice(candidates: DataFrame) -> DataFrame:
    """The candidate nearest to one header row and one header column without looking at types: one header column
    first, then at least one header row, then the fewest rows, the fewest steps, the id."""
    key = F.struct(F.col("vmd") != 1, F.col("hmd") < 1, "hmd", F.abs(F.col("hmd") - 1) + F.abs(F.col("vmd") - 1), "candidate_id")
    return candidates.groupBy(TABLE).agg(F.min_by("candidate_id", key).alias("selected_candidate_id"))


def random_expectation(candidates: DataFrame) -> DataFrame:
    """How many tables a random choice would get right, if one candidate of each is."""
    per = candidates.groupBy(TABLE).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_tables"), F.sum(1 / F.col("n")).alias("expected"))
