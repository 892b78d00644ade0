"""Reading, pairing, filtering and writing of table records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.sources.shared import kept

TABLE = "table_uid"


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines with a given schema; a broken line fails the read, a blank one is skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """(path, xml, sha256, bytes), one row per file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("xml"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def write_by_article(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Replaces the articles that df holds and leaves the others."""
    df.write.format(form).partitionBy("pmc_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").save(path)


def unpaired(records: DataFrame, types: DataFrame) -> DataFrame:
    """Tables that only one of two record sets has, with the side that lacks them."""
    both = records.select(TABLE, F.lit(True).alias("r")).distinct().join(types.select(TABLE, F.lit(True).alias("t")).distinct(), TABLE, "full")
    return both.where("r IS NULL OR t IS NULL").select(TABLE, F.when(F.col("r").isNull(), "records").otherwise("types").alias("missing_from"))


def restrict(df: DataFrame, wanted: DataFrame, key: str = "pmc_id") -> DataFrame:
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def missing(wanted: DataFrame, df: DataFrame, key: str = "pmc_id") -> DataFrame:
    return wanted.select(key).distinct().join(df.select(key), key, "left_anti")


def selected_tables(tables: DataFrame, uids: DataFrame) -> DataFrame:
    """Every table, queued or not_selected. Uids that are not PMC<digits>/t<digits> select nothing."""
    valid = uids.where(F.col(TABLE).rlike("^PMC[0-9]+/t[0-9]+$")).select(TABLE, F.lit(True).alias("asked")).distinct()
    return tables.join(valid, TABLE, "left").select(TABLE, F.when(F.col("asked"), "queued").otherwise("not_selected").alias("status"))


def preferred_types(guided: DataFrame, ruled: DataFrame) -> DataFrame:
    """By article its guided records if they describe the same tables as the ruled ones, else the ruled ones."""
    of = lambda df, n: df.groupBy("pmc_id").agg(F.sort_array(F.collect_set(TABLE)).alias(n))
    good = of(ruled, "r").join(of(guided, "g"), "pmc_id").where("r = g").select("pmc_id")
    return guided.join(good, "pmc_id", "left_semi").withColumn("types_file", F.lit("guided")).unionByName(ruled.join(good, "pmc_id", "left_anti").withColumn("types_file", F.lit("rules")))


def reusable(results: DataFrame, current: DataFrame) -> DataFrame:
    """Articles whose every result has the current input hash, prompt version and model and is settled."""
    same = results.join(current, "pmc_id").withColumn("good", (F.col("input_hash") == F.col("current_hash")) & (F.col("model") == F.col("current_model")) & ~F.col("status").isin("failed", "not_selected"))
    return same.groupBy("pmc_id").agg(F.bool_and("good").alias("good")).where("good").select("pmc_id")


def readable_articles(records: DataFrame) -> DataFrame:
    """Articles all of whose records have schema version 2 or 3."""
    return records.groupBy("pmc_id").agg(F.bool_and(F.col("schema_version").rlike("^[23]\\.")).alias("good")).where("good").select("pmc_id")


def article_verdicts(tables: DataFrame) -> DataFrame:
    """complete, partial or failed by the number of an article's quarantined tables."""
    per = tables.groupBy("pmc_id").agg(F.count("*").alias("n_tables"), F.count_if(F.col("status") == "quarantined").alias("n_quarantined"))
    return per.withColumn("verdict", F.when(F.col("n_quarantined") == 0, "complete").when(F.col("n_quarantined") < F.col("n_tables"), "partial").otherwise("failed"))


#: The outputs that are written one after the other for an article, and what each must hold.
OUTPUTS = {
    "types": ("table_uid", "cell_id", "type", "family", "group", "source"),
    "guided_types": ("table_uid", "cell_id", "type", "guided_type", "derivation"),
    "selections": ("table_uid", "status", "selected_candidate_id", "selected_by", "margin", "scores"),
    "reviews": ("table_uid", "review_status", "final_status", "decided_by", "selected_candidate_id"),
    "exports": ("table_uid", "candidate_id", "final_status", "export_error"),
}


def write_output(df: DataFrame, folder: str, kind: str, parts: int = 256) -> str:
    """Writes one kind of output as JSON Lines under <folder>/<kind>, replacing the articles that df holds and leaving the
    others; null fields are written. The article (pmc_id) is the part of table_uid before /t. Articles are dealt over
    `parts` folders, the same number every time, so that files stay few; of a folder that df touches, what stays is written
    to the shared folder and from there back with the new rows. ValueError for a kind that is not known, or a column
    that it lacks. Returns the output's folder, for read_output."""
    if kind not in OUTPUTS:
        raise ValueError(f"unknown output {kind}")
    if lacking := [c for c in OUTPUTS[kind] if c not in df.columns]:
        raise ValueError(f"{kind} without {', '.join(lacking)}")
    spark, path = df.sparkSession, f"{folder}/{kind}"
    named = kept(df.withColumn("pmc_id", F.split_part(TABLE, F.lit("/t"), F.lit(1))).withColumn("part", F.pmod(F.crc32(F.col("pmc_id").cast("binary")), F.lit(parts)).cast("int")))
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        before = spark.read.schema(named.schema).option("mode", "FAILFAST").json(path)
        staying = before.join(named.select("part").distinct(), "part", "left_semi").join(named.select("pmc_id").distinct(), "pmc_id", "left_anti")
        named = named.unionByName(kept(staying))
    named.repartition("part").write.option("ignoreNullFields", "false").partitionBy("part").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)
    return path


def read_output(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_output wrote, with the given schema and the article; a broken line fails the read."""
    return spark.read.schema(f"{schema}, pmc_id string").option("mode", "FAILFAST").json(path)


# Why an article failed, by error, {t} being the table and {0}, {1}, ... the error's arguments.
REASONS = (
    ("all_tables_quarantined", "all {0} source tables quarantined; no replacement published", "all {0} source tables quarantined; no replacement published"),
    ("table_processing_failure", "table {t} processing: {0}", "table {t} processing: {0}"),
    ("table_rasterization_failed", "table {t} rasterization returned failure", "table {t} rasterization returned failure"),
    ("table_layout_error", "table {t} invalid layout: {0}", "invalid table layout: {0}"),
    ("table_output_failure", "table {t} output: {0}", "table {t} output: {0}"),
    ("incomplete_paper_stage", "stage validation: {0}", "stage validation: {0}"),
    ("table_raster_limit_exceeded", "table {t} raster limit {0} exceeded ({2} > {1})", "raster limit {0} exceeded ({2} > {1})"),
    ("paper_raster_limit_exceeded", "table {t} paper raster limit {0} exceeded ({2} > {1})", "paper raster limit {0} exceeded ({2} > {1})"),
    ("ncbi_download_invalid", "NCBI {0} response invalid: {1}", "NCBI {0} response invalid: {1}"),
    ("pmc_article_identity_mismatch", "PMC article identity mismatch (expected {0}, found {1})", "PMC article identity mismatch (expected {0}, found {1})"),
    ("invalid_jats_xml", "invalid JATS XML: {0}", "invalid JATS XML: {0}"),
    ("pipeline_goal_failed", "download or processing returned failure", "download or processing returned failure"),
)


def failure_reason(error: Column, table: Column, arguments: Column) -> Column:
    """An error's message, with and without a table it happened at (null); an error not listed is its own message, no
    error null. `arguments` is an array of strings, a missing one shown as '?'."""

    def said(form: str) -> Column:
        pieces = re.split(r"\{(\w)\}", form)
        shown = [F.lit(p) if n % 2 == 0 else F.coalesce(table.cast("string") if p == "t" else F.get(arguments, F.lit(int(p))), F.lit("?")) for n, p in enumerate(pieces)]
        return F.concat(*shown)

    out = F.when(error.isNull(), F.lit(None).cast("string"))
    for name, at_table, elsewhere in REASONS:
        out = out.when((error == name) & table.isNotNull(), said(at_table)).when(error == name, said(elsewhere))
    return out.otherwise(error)


def latest_attempts(attempts: DataFrame) -> DataFrame:
    """The last attempt at each article of each run, of an append-only log (run_id, pmc_id, seq, status, detail)."""
    return attempts.groupBy("run_id", "pmc_id").agg(F.max(F.struct("seq", "status", "detail")).alias("last"), F.count("*").alias("attempts")).select("run_id", "pmc_id", "last.status", "last.detail", "attempts")


def run_papers(observed: DataFrame, proposed: DataFrame, attempts: DataFrame) -> DataFrame:
    """The articles that a run saw or a model proposed in it, one row each: run_id, pmc_id, decision and the last attempt's status
    and detail. observed: run_id, pmc_id, query (searches that gave it); proposed: run_id, pmc_id. Only an observed article can
    be selected; a proposed one that was not is rejected; the others were offered."""
    seen = observed.select("run_id", "pmc_id").distinct().withColumn("seen", F.lit(True))
    asked = proposed.select("run_id", "pmc_id").distinct().withColumn("asked", F.lit(True))
    both = seen.join(asked, ["run_id", "pmc_id"], "full")
    decision = F.when(F.col("asked").isNull(), "offered").when(F.col("seen").isNull(), "rejected").otherwise("selected")
    named = both.select("run_id", "pmc_id", decision.alias("decision"))
    tried = latest_attempts(attempts)
    return named.join(tried, ["run_id", "pmc_id"], "left").select("run_id", "pmc_id", "decision", F.when(F.col("decision") == "selected", F.coalesce("status", F.lit("not_attempted"))).alias("status"), "detail", F.coalesce("attempts", F.lit(0)).alias("attempts"))


def run_manifests(runs: DataFrame, observed: DataFrame, papers: DataFrame) -> DataFrame:
    """One row per run (run_id and whatever else runs holds): the number of queries that found something, and of articles offered,
    selected, rejected, complete, partial, failed and not attempted. Lists of articles stay rows of run_papers, so that a
    run of any size is counted before it is shuffled."""
    searches = observed.select("run_id", "query").distinct().groupBy("run_id").agg(F.count("*").alias("queries"))
    count = lambda column, value: F.count_if(F.col(column) == value).alias(value)
    counts = papers.groupBy("run_id").agg(*[count("decision", d) for d in ("offered", "selected", "rejected")], *[count("status", s) for s in ("complete", "partial", "failed", "not_attempted")])
    out = runs.join(searches, "run_id", "left").join(counts, "run_id", "left")
    return out.fillna(0, ["queries", "offered", "selected", "rejected", "complete", "partial", "failed", "not_attempted"])
