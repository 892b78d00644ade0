"""Measures of types, candidates and reviews."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.operators.rules import IGNORED
from tablewright.sources.shared import kept, kept_by_table

TABLE = "table_uid"
#: Purities this close are the same, whatever the order in which they were summed.
SAME = 1e-12


def mutual_information(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mutual information of columns x and y and the entropy of y in bits, over all rows or by group."""
    by = by or []
    n = pairs.groupBy(*by, "x", "y").agg(F.count("*").alias("c"))
    within = lambda *more: W.partitionBy(*by, *more) if by or more else W.partitionBy(F.lit(1))
    sums = n.withColumn("cx", F.sum("c").over(within("x"))).withColumn("cy", F.sum("c").over(within("y"))).withColumn("n", F.sum("c").over(within()))
    c, total = F.col("c"), F.col("n")
    return sums.groupBy(*by).agg(F.sum(c / total * F.log2(c * total / (F.col("cx") * F.col("cy")))).alias("mi"), F.sum(-c / total * F.log2(F.col("cy") / total)).alias("entropy"))


def macro_information(per: DataFrame) -> DataFrame:
    """The mean over tables, as bits and as a share of the regions' entropy."""
    return per.agg(F.avg("mi").alias("mi"), F.try_divide(F.avg("mi"), F.avg("entropy")).alias("share"))


def share_given(pairs: DataFrame) -> DataFrame:
    """How often each x goes with each y, as a share of y."""
    n = pairs.groupBy("x", "y").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("y")))


def line_contrast(slots: DataFrame, regions: DataFrame, cell_types: DataFrame, level: str = "family") -> DataFrame:
    """(table_uid, axis, differing, n_lines): data columns (col) and rows (row) whose heading's type differs from the
    commonest type of their cells, of equally common ones the first on the line. Empty, untyped and Missing cells
    count neither as cells nor as headings; the heading is the last header cell on the line.
    regions: table_uid, cell_id, region."""
    types = cell_types.select(TABLE, "cell_id", "family", F.col(level).alias("kind"))
    at = slots.join(regions.select(TABLE, "cell_id", "region"), [TABLE, "cell_id"]).join(types, [TABLE, "cell_id"])
    kind = F.when(~F.col("family").isin(*IGNORED), F.struct("kind"))  # null: counts neither as cell nor as heading
    axis = lambda name, line, along, head: F.struct(F.lit(name).alias("axis"), F.col(line).alias("line"), F.col(along).alias("along"), F.lit(head).alias("head"))
    each = at.select(TABLE, "cell_id", "region", kind.alias("kind"), F.inline(F.array(axis("col", "col_idx", "row_idx", "hmd"), axis("row", "row_idx", "col_idx", "vmd"))))
    heads, data = F.col("region") == F.col("head"), (F.col("region") == "data") & F.col("kind").isNotNull()
    line = [TABLE, "axis", "line"]
    of_cell = each.where(heads | data).groupBy(*line, "region", "cell_id", "kind").agg(F.min("along").alias("seen"), F.max("along").alias("last"))
    of_kind = of_cell.groupBy(*line, "region", "kind").agg(F.count("*").alias("k"), F.min("seen").alias("seen"), F.max("last").alias("last"))
    in_data = F.col("region") == "data"
    of_line = of_kind.groupBy(*line).agg(F.max_by("kind", F.when(in_data, F.struct("k", -F.col("seen")))).alias("mode"), F.max_by("kind", F.when(~in_data, F.col("last"))).alias("heading"))
    both = of_line.where("mode IS NOT NULL AND heading.kind IS NOT NULL")
    return both.groupBy(TABLE, "axis").agg(F.count_if(F.col("mode.kind") != F.col("heading.kind")).alias("differing"), F.count("*").alias("n_lines"))


def contrast_summary(contrasts: DataFrame) -> DataFrame:
    """Lines and the share of them with a differing heading, by axis over all tables."""
    return contrasts.groupBy("axis").agg(F.sum("n_lines").alias("n_lines"), F.try_divide(F.sum("differing").cast("double"), F.sum("n_lines")).alias("share"))


def data_kinds(regions: DataFrame) -> DataFrame:
    """Whether the typed data cells of a table are mostly Numeric, mostly Text or mixed; mixed without any.
    regions: table_uid, region, family."""
    data, typed = F.col("region") == "data", ~F.col("family").isin(*IGNORED)
    share = lambda family: F.count_if(data & (F.col("family") == family)) * 2 > F.count_if(data & typed)
    per = regions.groupBy(TABLE).agg(share("Numeric").alias("numeric"), share("Text").alias("text"))
    return per.select(TABLE, F.when(F.col("numeric"), "mostly_numeric").when(F.col("text"), "mostly_text").otherwise("mixed").alias("kind"))


def purity_comparison(gold: DataFrame, others: DataFrame) -> DataFrame:
    """By axis: tables compared, mean purity of the gold boundary and of the other ones (their mean in each table),
    and how often gold is purer than all others or as pure as the best. Both: table_uid, axis, purity."""
    other = others.where("purity IS NOT NULL").groupBy(TABLE, "axis").agg(F.avg("purity").alias("mean"), F.max("purity").alias("best"))
    both = gold.where("purity IS NOT NULL").select(TABLE, "axis", "purity").join(other, [TABLE, "axis"])
    share = lambda hit: F.avg(hit.cast("double"))
    return both.groupBy("axis").agg(
        F.count("*").alias("tables"), F.avg("purity").alias("gold_purity"), F.avg("mean").alias("other_purity"),
        share(F.col("purity") - F.col("best") > SAME).alias("gold_purest"), share(F.abs(F.col("purity") - F.col("best")) <= SAME).alias("gold_tied"),
    )


def region_purities(slots: DataFrame, regions: DataFrame, cell_types: DataFrame, level: str = "family") -> DataFrame:
    """(table_uid, axis, purity): the mean share of the commonest type over data columns (col) and data rows (row), a cell
    once a line; null without typed data. regions: table_uid, cell_id, region."""
    types = cell_types.where(~F.col("family").isin(*IGNORED)).select(TABLE, "cell_id", F.col(level).alias("kind"))
    data = slots.join(regions.where("region = 'data'").select(TABLE, "cell_id"), [TABLE, "cell_id"]).join(types, [TABLE, "cell_id"])
    lines = data.select(TABLE, "cell_id", "kind", F.explode(F.array(F.struct(F.lit("col").alias("axis"), F.col("col_idx").alias("line")), F.struct(F.lit("row").alias("axis"), F.col("row_idx").alias("line")))).alias("l")).select(TABLE, "cell_id", "kind", "l.*").distinct()
    per = lines.groupBy(TABLE, "axis", "line", "kind").agg(F.count("*").alias("k")).groupBy(TABLE, "axis", "line").agg((F.max("k") / F.sum("k")).alias("purity"))
    return per.groupBy(TABLE, "axis").agg(F.avg("purity").alias("purity"))


#: The plain boundaries that gold is held against have at most so many header rows and columns.
OTHER_ROWS, OTHER_COLUMNS = 4, 3


def boundary_purities(slots: DataFrame, cell_types: DataFrame, gold: DataFrame, level: str = "family") -> DataFrame:
    """(table_uid, hmd, vmd, axis, purity) of every plain boundary up to OTHER_ROWS x OTHER_COLUMNS that leaves data, cuts no
    cell and labels the cells otherwise than gold (table_uid, cell_id, region) does, a row for each axis.

    Every boundary's line counts come from one pass: for each line and type the cells that begin at or after each possible
    cut, which are those in the data, since no cell is cut.
    """
    rows, columns = range(OTHER_ROWS + 1), range(OTHER_COLUMNS + 1)
    box = slots.groupBy(TABLE, "cell_id").agg(F.min("row_idx").alias("r0"), F.max("row_idx").alias("r1"), F.min("col_idx").alias("c0"), F.max("col_idx").alias("c1"))
    named = box.join(gold.select(TABLE, "cell_id", "region"), [TABLE, "cell_id"], "left")
    cut = lambda h, v: ((F.col("r0") < h) & (F.col("r1") >= h)) | ((F.col("r0") >= h) & (F.col("c0") < v) & (F.col("c1") >= v))
    label = lambda h, v: F.when(F.col("r0") < h, "hmd").when(F.col("c0") < v, "vmd").otherwise("data")
    flags = [F.struct(F.lit(h).alias("hmd"), F.lit(v).alias("vmd"), F.bool_or(cut(h, v)).alias("cut"), F.bool_and(F.col("region").eqNullSafe(label(h, v))).alias("same")) for h in rows for v in columns if h + v]
    tables = named.groupBy(TABLE).agg((F.max("r1") + 1).alias("n_rows"), (F.max("c1") + 1).alias("n_cols"), F.array(*flags).alias("f"))
    other = tables.select(TABLE, "n_rows", "n_cols", F.explode("f").alias("b")).select(TABLE, "n_rows", "n_cols", "b.*").where("hmd < n_rows AND vmd < n_cols AND NOT cut AND NOT same").select(TABLE, "hmd", "vmd")

    types = cell_types.where(~F.col("family").isin(*IGNORED)).select(TABLE, "cell_id", F.col(level).alias("kind"))
    known = slots.join(box.select(TABLE, "cell_id", "r0", "c0"), [TABLE, "cell_id"]).join(types, [TABLE, "cell_id"])

    def lines(axis: str, line: str, begins: str, cuts: range) -> DataFrame:
        """(table_uid, line, share array): by the cut across the line, the share of the commonest type after it."""
        cells = known.select(TABLE, F.col(line).alias("line"), "cell_id", "kind", begins).distinct()
        per = cells.groupBy(TABLE, "line", "kind").agg(*[F.count_if(F.col(begins) >= k).alias(f"k{k}") for k in cuts])
        shares = F.array(*[F.try_divide(F.max(f"k{k}"), F.sum(f"k{k}")) for k in cuts])
        return per.groupBy(TABLE, "line").agg(shares.alias("shares")).select(TABLE, F.lit(axis).alias("axis"), "line", "shares")

    by_line = lines("col", "col_idx", "r0", rows).unionByName(lines("row", "row_idx", "c0", columns))
    summed = by_line.groupBy(TABLE, "axis").agg(F.collect_list(F.struct("line", "shares")).alias("lines"))
    at = other.join(summed, TABLE)
    first, across = F.when(F.col("axis") == "col", F.col("vmd")).otherwise(F.col("hmd")), F.when(F.col("axis") == "col", F.col("hmd")).otherwise(F.col("vmd"))
    taken = F.transform(F.filter("lines", lambda x: (x["line"] >= first) & F.get(x["shares"], across).isNotNull()), lambda x: F.get(x["shares"], across))
    mean = F.try_divide(F.aggregate(taken, F.lit(0.0), lambda a, x: a + x), F.size(taken))
    return at.select(TABLE, "hmd", "vmd", "axis", mean.alias("purity"))


def labelled_set(tables: DataFrame, gold: DataFrame, least_confidence: float) -> DataFrame:
    """Gold rows of at least a confidence that name a candidate, joined to their tables; gold for an unknown table
    is an error. gold: table_uid, gold_candidate, confidence."""
    sure = gold.where((F.col("confidence") >= least_confidence) & F.col("gold_candidate").isNotNull()).withColumn("labelled", F.lit(True))
    known = tables.withColumn("_known", F.lit(True)).join(sure, TABLE, "right")
    checked = known.withColumn("_known", F.coalesce("_known", F.raise_error(F.concat(F.lit("no table "), TABLE)).cast("boolean")))
    return checked.where("_known").drop("_known", "labelled")


def structural_metrics(tables: DataFrame, candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """One row of rates over labelled tables; null where nothing is counted. Precision is of all tables with a unique
    prediction; coverage, exact match, abstention and ambiguity are of all labelled tables; a quarantined table is
    neither unique, ambiguous nor abstained. A labelled table without a record is an error.
    tables: table_uid, status (optional); gold: table_uid, hmd, vmd (both null: no header)."""
    hit = candidates.join(gold.select(TABLE, "hmd", "vmd"), [TABLE, "hmd", "vmd"], "left_semi").select(TABLE).distinct().withColumn("hit", F.lit(True))
    n = candidates.groupBy(TABLE).agg(F.count("*").alias("n"))
    status = F.col("status") if "status" in tables.columns else F.lit("ok")
    records = tables.select(TABLE, (status == "quarantined").alias("quarantined")).distinct()
    known = gold.join(records, TABLE, "left").withColumn("quarantined", F.coalesce("quarantined", F.raise_error(F.concat(F.lit("no prediction for "), TABLE)).cast("boolean")))
    per = known.join(n, TABLE, "left").join(hit, TABLE, "left").select("quarantined", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hit", F.lit(False)).alias("hit"), F.col("hmd").isNotNull().alias("real"))
    share = lambda a, b: F.try_divide(F.count_if(a).cast("double"), F.count_if(b))
    every, read = F.lit(True), ~F.col("quarantined")
    one = read & (F.col("n") == 1)
    right = F.col("real") & F.col("hit") & (F.col("n") == 1)
    return per.agg(
        share(F.col("hit") & F.col("real"), F.col("real")).alias("candidate_recall"), share(right, one).alias("unique_precision"), share(one, every).alias("unique_coverage"), share(right, every).alias("exact_match"),
        share(~F.col("real") & (F.col("n") > 0), ~F.col("real")).alias("false_rate"), share(read & (F.col("n") == 0), every).alias("abstention"), share(read & (F.col("n") > 1), every).alias("ambiguity"),
    )


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def method_accuracy(results: DataFrame, n: int | None = None) -> DataFrame:
    """Tables decided and correct by method, coverage of all labelled tables and accuracy. results: method, table_uid, chosen, gold."""
    total = F.countDistinct(TABLE) if n is None else F.lit(n)
    per = results.groupBy("method").agg(F.count("chosen").alias("decided"), F.count_if(F.col("chosen") == F.col("gold")).alias("correct"), total.alias("n"))
    return per.select("method", "decided", "correct", (F.col("decided") / F.col("n")).alias("coverage"), F.try_divide("correct", "decided").alias("accuracy"))


def running(rows: DataFrame, by: list[str], order: list, value: str, parts: int = 64) -> DataFrame:
    """rows with n, their place, and total, the sum of `value` up to them, in `order` within `by`. Rows are dealt by
    range of the order, so a group of any size is summed by ranges and then within each: no task has a whole group. The
    dealt rows are written, so that sums and rows are of one and the same deal."""
    dealt = kept(rows.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()))
    inside = W.partitionBy(*by, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = dealt.withColumn("n", F.count("*").over(inside)).withColumn("total", F.sum(value).over(inside))
    sums = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.sum(value).alias("_total"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # as many rows as ranges
    offsets = sums.select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_total"))
    out = local.join(F.broadcast(offsets), [*by, "_part"])
    return out.withColumn("n", F.col("n") + F.col("_n")).withColumn("total", F.col("total") + F.col("_total")).drop("_part", "_n", "_total")


def risk_coverage(results: DataFrame) -> DataFrame:
    """Accuracy of the n surest choices for each n, by falling margin. results: method, table_uid, margin, correct (0 or 1)."""
    found = running(results, ["method"], [F.col("margin").desc(), F.col(TABLE)], "correct")
    return found.select("method", TABLE, "n", (F.col("total") / F.col("n")).alias("accuracy"))


def outcome_class(final_status, export_error, accepted_correct):
    """What became of a table: only a valid result can be exported, and so be invalid output."""
    valid = F.when(export_error.isNotNull(), "invalid_output").when(accepted_correct, "correct").otherwise("wrong_accepted")
    return F.when(final_status == "valid", valid).when(final_status == "unparseable", "rejected").otherwise("not_reviewed")


def place_labels(slots: DataFrame, rectangles: DataFrame, separators: DataFrame) -> DataFrame:
    """The region of each place by a segmentation: separator rows first, then the first rectangle (by first column,
    then first row) that holds the place, its header rows counted without separator rows; uncovered outside all.
    rectangles: table_uid, first_row, last_row, first_col, last_col, head_rows, side_cols; separators: table_uid, row_idx.
    Tables without a rectangle or a separator have no segmentation and get no rows."""
    r, c = F.col("row_idx"), F.col("col_idx")
    aside = separators.select(TABLE, "row_idx", F.lit(True).alias("aside")).distinct()
    rows = slots.select(TABLE, "row_idx").distinct().join(aside, [TABLE, "row_idx"], "left").withColumn("aside", F.coalesce("aside", F.lit(False)))
    before = F.sum(F.col("aside").cast("int")).over(W.partitionBy(TABLE).orderBy("row_idx").rowsBetween(W.unboundedPreceding, 0)) - F.col("aside").cast("int")
    tables = lambda df, name: df.select(TABLE).distinct().withColumn(name, F.lit(True))
    told = rows.withColumn("before", before).join(tables(rectangles, "parted"), TABLE, "left").join(tables(separators, "lined"), TABLE, "left").where("parted OR lined")
    rows = kept_by_table(told.drop("parted", "lined"))
    first = rows.select(TABLE, F.col("row_idx").alias("first_row"), F.col("before").alias("before_first"))
    rect = rectangles.join(first, [TABLE, "first_row"])
    places = slots.select(TABLE, "row_idx", "col_idx").join(rows, [TABLE, "row_idx"])
    inside = places.join(rect, TABLE).where((r >= F.col("first_row")) & (r <= F.col("last_row")) & (c >= F.col("first_col")) & (c <= F.col("last_col")))
    at = r - F.col("first_row") - F.col("before") + F.col("before_first")
    region = F.when(at < F.col("head_rows"), "hmd").when(c - F.col("first_col") < F.col("side_cols"), "vmd").otherwise("data")
    held = inside.groupBy(TABLE, "row_idx", "col_idx").agg(F.min_by(region, F.struct("first_col", "first_row")).alias("held"))
    out = places.join(held, [TABLE, "row_idx", "col_idx"], "left")
    return out.select(TABLE, "row_idx", "col_idx", F.when(F.col("aside"), "separator").otherwise(F.coalesce("held", F.lit("uncovered"))).alias("region"))


def cell_accuracy(cells: DataFrame, answer: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of a table's cells, gap cells left out, that an answer labels as gold does, each by its first place; null
    for a table without an answer or gold. answer, gold: table_uid, row_idx, col_idx, region."""
    real = cells.where(F.coalesce(F.col("kind") != "synthetic_gap", F.lit(True))) if "kind" in cells.columns else cells
    named = lambda d, n: d.select(TABLE, "row_idx", "col_idx", F.col("region").alias(n))
    both = real.select(TABLE, "row_idx", "col_idx").join(named(answer, "given"), [TABLE, "row_idx", "col_idx"], "left").join(named(gold, "wanted"), [TABLE, "row_idx", "col_idx"], "left")
    return both.groupBy(TABLE).agg(F.avg((F.col("given") == F.col("wanted")).cast("double")).alias("accuracy"))


def usage(log: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls, tokens and cost by arm, all models together. log: arm, model, tokens; prices: model, price."""
    per = log.groupBy("arm", "model").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens")).join(F.broadcast(prices), "model", "left")
    return per.groupBy("arm").agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.coalesce("price", F.lit(0.0))).alias("cost"))


def summary(results: DataFrame, arm: str, part: str, outcome: str) -> DataFrame:
    """Counts of outcomes by arm and part, by arm over all parts, and over everything."""
    return results.rollup(arm, part).agg(F.count("*").alias("n"), F.count_if(F.col(outcome) == "correct").alias("correct"))


def paired(results: DataFrame, first: str, second: str) -> DataFrame:
    """Tables that only one of two methods gets right, both, or neither. results: method, table_uid, correct (boolean)."""
    per = results.where(F.col("method").isin(first, second)).groupBy(TABLE).agg(F.bool_or((F.col("method") == first) & F.col("correct")).alias("a"), F.bool_or((F.col("method") == second) & F.col("correct")).alias("b"), F.countDistinct("method").alias("m")).where("m = 2")
    return per.agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_first"), F.count_if(F.col("b") & ~F.col("a")).alias("only_second"), F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(~F.col("a") & ~F.col("b")).alias("neither"))


def exact_p(only_first: int, only_second: int) -> float:
    """Two-sided exact McNemar probability."""
    n, least = only_first + only_second, min(only_first, only_second)
    if not n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2) for k in range(least + 1)]
    most = max(logs)
    return min(1.0, 2 * math.exp(most) * math.fsum(math.exp(x - most) for x in logs))


def paired_probability(counts: DataFrame) -> DataFrame:
    """paired() with p, the exact McNemar probability of its two counts."""
    row = counts.first().asDict()
    return counts.withColumn("p", F.lit(exact_p(row["only_first"], row["only_second"])))


def end_to_end(accuracies: DataFrame, tables: DataFrame, arm: str = "arm") -> DataFrame:
    """(arm, n_answered, answered, end_to_end): the mean cell accuracy of the answered tables, and of all tables with 0 for
    those without an answer. accuracies: arm, table_uid, accuracy (null or no row: no answer); tables: arm, table_uid."""
    every = tables.select(arm, TABLE).distinct().join(accuracies.select(arm, TABLE, "accuracy"), [arm, TABLE], "left")
    return every.groupBy(arm).agg(F.count("accuracy").alias("n_answered"), F.avg("accuracy").alias("answered"), F.avg(F.coalesce("accuracy", F.lit(0.0))).alias("end_to_end"))


def slice_rates(records: DataFrame, slices) -> DataFrame:
    """Counts and the disagreement rate of each of the slices (an array column) that a record belongs to. records: disagrees (boolean)."""
    return records.select(F.explode(slices).alias("slice"), "disagrees").groupBy("slice").agg(F.count("*").alias("n"), F.count_if("disagrees").alias("disagreeing"), F.avg(F.col("disagrees").cast("double")).alias("rate"))


def mixed_provenance(records: DataFrame, *columns: str) -> DataFrame:
    """How many different values each of the columns has; a homogeneous set has one of each."""
    return records.agg(*[F.countDistinct(c).alias(c) for c in columns])


def permuted_information(pairs: DataFrame, times: int, seed: int = 0) -> DataFrame:
    """(replicate, mi, macro): mutual information of x and y, pooled and as the mean over tables, after shuffling
    y inside each table. Each table's task emits the counts of every replicate and its own information, not its
    rows, and shuffles blocks of replicates of about 2,000,000 places (one replicate at least)."""
    import zlib

    import numpy as np
    import pandas as pd

    def shuffle(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, zlib.crc32(str(key[0]).encode())])
        x, xs = pd.factorize(part["x"], sort=True)
        y, ys = pd.factorize(part["y"], sort=True)
        size, block, out = len(xs) * len(ys), max(1, 2_000_000 // len(part)), []
        expected = np.bincount(x)[:, None] * np.bincount(y) / len(part)
        for first in range(0, times, block):
            some = min(block, times - first)
            shuffled = rng.permuted(np.tile(y, (some, 1)), axis=1)
            cell = (np.arange(some)[:, None] * len(xs) + x) * len(ys) + shuffled
            counts = np.bincount(cell.ravel(), minlength=some * size)
            ratio = counts.reshape(some, len(xs), len(ys)) / expected
            own = (ratio * expected * np.log2(np.where(ratio > 0, ratio, 1))).sum(axis=(1, 2)) / len(part)
            at = np.flatnonzero(counts)
            out.append(pd.DataFrame({"replicate": first + at // size, "x": xs[at // len(ys) % len(xs)], "y": ys[at % len(ys)], "c": counts[at], "own": None}))
            out.append(pd.DataFrame({"replicate": first + np.arange(some), "x": None, "y": None, "c": None, "own": own}))
        return pd.concat([o.astype({"x": object, "y": object, "c": "Int64", "own": "Float64"}) for o in out])

    counted = pairs.select(TABLE, "x", "y").groupBy(TABLE).applyInPandas(shuffle, "replicate int, x string, y string, c long, own double")
    n = counted.groupBy("replicate", "x", "y").agg(F.sum("c").alias("c"), F.avg("own").alias("own"))
    within = lambda *more: W.partitionBy("replicate", *more)
    c, total = F.col("c"), F.sum("c").over(within())
    return n.withColumn("term", c / total * F.log2(c * total / (F.sum("c").over(within("x")) * F.sum("c").over(within("y"))))).groupBy("replicate").agg(F.sum("term").alias("mi"), F.max("own").alias("macro"))


def permutation_baseline(observed: float, permuted: DataFrame, macro: float | None = None) -> DataFrame:
    """Mean and greatest of the permuted values, and (1 + those not below the observed) / (1 + all), pooled;
    with `macro`, the observed mean over tables, the mean and probability of that too."""
    def p(value: str, seen: float):
        return (1 + F.count_if(F.col(value) >= seen - 1e-9)) / (1 + F.count("*"))

    more = [F.avg("macro").alias("macro_mean"), p("macro", macro).alias("macro_p")] if macro is not None else []
    return permuted.agg(F.avg("mi").alias("mean"), F.max("mi").alias("most"), p("mi", observed).alias("p"), *more)


def agreement(given: DataFrame, labelled: DataFrame, without: list[str] | None = None) -> DataFrame:
    """How many labelled cells have the labelled type and group. given: table_uid, cell_id, type, group; labelled:
    table_uid, cell_id, wanted_type, wanted_group; `without`: articles left out."""
    article = F.split_part(F.col(TABLE), F.lit("/t"), F.lit(1))
    both = labelled.where(~article.isin(*without)) if without else labelled
    both = both.join(given.select(TABLE, "cell_id", "type", "group"), [TABLE, "cell_id"], "left")
    share = lambda a, b: F.avg(F.coalesce(F.col(a) == F.col(b), F.lit(False)).cast("double"))
    return both.agg(F.count("*").alias("n"), share("type", "wanted_type").alias("type_agreement"), share("group", "wanted_group").alias("group_agreement"))


def ablation_lines(sample: DataFrame, arms: list[str], reviews: DataFrame, gold: DataFrame) -> DataFrame:
    """One line for every table of the sample and every arm: what the arm's review says, and whether the segmentations it
    proposed (llm) and accepted are the gold one.

    sample: table_uid. reviews: arm, table_uid, review_status, final_status, decided_by, selected_candidate_id, export_error,
    candidate (the segmentation that selected_candidate_id names, null if none does), proposed (the boundary or
    segmentation in the answer), any comparable type. gold: table_uid, gold_candidate, gold (null if unlabelled). In the arm
    `full` a valid review accepts its candidate, which is also the model's if the model decided, else the model's is what it
    proposed; in any other arm the answer is the segmentation and a valid review accepts it. A table that an arm has no
    review of is missing there. A segmentation that is not there is neither right nor wrong (null).
    """
    wanted = sample.select(TABLE).distinct().withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    valid = F.coalesce(F.col("final_status") == "valid", F.lit(False))
    accepted = F.when(valid, F.when(F.col("arm") == "full", F.col("candidate")).otherwise(F.col("proposed")))
    by_model = (F.col("arm") == "full") & accepted.isNotNull() & F.coalesce(F.col("decided_by") == "llm", F.lit(False))
    told = reviews.select("arm", TABLE, "review_status", "final_status", "decided_by", "selected_candidate_id", "export_error", accepted.alias("accepted"), F.when(by_model, accepted).otherwise(F.col("proposed")).alias("llm"))
    out = wanted.join(told, ["arm", TABLE], "left").join(gold.select(TABLE, "gold_candidate", "gold"), TABLE, "left")
    return out.select(
        TABLE, "arm", "gold_candidate", "gold", F.coalesce("review_status", F.lit("missing")).alias("review_status"), "final_status", "decided_by", "selected_candidate_id", "export_error",
        "accepted", "llm", (F.col("accepted") == F.col("gold")).alias("accepted_correct"), (F.col("llm") == F.col("gold")).alias("llm_correct"),
    )


def pool_runs(lines: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Several runs as one: lines (run, arm, table_uid, ...) as they are, and runs (run, model) with their number of tables.
    ValueError if an arm scored a table twice, or if the runs used different models."""
    twice = duplicate_keys(lines, "arm", TABLE).first()
    if twice:
        raise ValueError(f"{twice[TABLE]} ({twice['arm']}) is in {twice['n']} lines")
    models = [r[0] for r in runs.select("model").distinct().sort("model").limit(2).collect()]
    if len(models) > 1:
        raise ValueError(f"the runs used different models: {', '.join(map(str, models))}")
    counts = lines.groupBy("run").agg(F.countDistinct(TABLE).alias("tables"))
    return lines, runs.join(counts, "run", "left").withColumn("tables", F.coalesce("tables", F.lit(0)))
