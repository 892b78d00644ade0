"""Types of text cells that outside answers refine."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.operators.rules import UNTYPED, Program, lookup

BATCH = 40


def routes(program: Program, cell_types: DataFrame) -> DataFrame:
    """Cells to ask about, with the guideline types that each may take: those below its rule type, or all for an
    untyped text with a letter; types in the order of their first guideline."""
    offered = list(dict.fromkeys(t for _, t in program.guidelines))
    below = {k: [t for t in offered if k in program.above(t)] for k in program.types()}
    allowed = lookup({k: "|".join(v) for k, v in below.items() if v}, F.col("type"))
    every = F.when((F.col("type") == UNTYPED) & F.col("text").rlike("\\p{L}"), "|".join(offered))
    return cell_types.withColumn("allowed", F.coalesce(every, allowed)).where(F.col("allowed").isNotNull())


def requests(routed: DataFrame, answers: DataFrame) -> DataFrame:
    """Distinct (pmc_id, text, rule_type, allowed) without an answer yet."""
    asked = routed.select("pmc_id", "text", F.col("type").alias("rule_type"), "allowed").distinct()
    return asked.join(answers.select("text", "rule_type"), ["text", "rule_type"], "left_anti")


def batches(asked: DataFrame, size: int = BATCH) -> DataFrame:
    """Requests in batches by article in text order: batch_id <article>/<n> and item, both from 1."""
    n = F.row_number().over(W.partitionBy("pmc_id").orderBy("text", "rule_type")) - 1
    out = asked.withColumn("n", n)
    return out.select("pmc_id", "text", "rule_type", "allowed", F.concat_ws("/", "pmc_id", (F.floor(F.col("n") / size) + 1).cast("string")).alias("batch_id"), (F.col("n") % size + 1).cast("int").alias("item"))


def latest(log: DataFrame, program_hash: str | None = None) -> DataFrame:
    """The last answer of each key of an append-only log (seq, text, rule_type, answer). With a program's hash only answers
    given under it count (program_sha256), so that a changed program asks anew."""
    current = log if program_hash is None else log.where(F.col("program_sha256") == program_hash)
    return current.groupBy("text", "rule_type").agg(F.max_by("answer", "seq").alias("answer"))


def program_hash(lines: list[str]) -> str:
    """SHA-256 of a program's lines, as programs.program_lines gives them: the key under which its answers are logged."""
    return sha256("".join(f"{line}\n" for line in lines).encode()).hexdigest()


def append_answers(log_path: str, answered: DataFrame, program: str) -> None:
    """Appends answers (seq, text, rule_type, answer, batch_id) to the log, under the hash of the program they were asked for."""
    answered.select("seq", F.lit(program).alias("program_sha256"), "text", "rule_type", "answer", "batch_id").write.mode("append").json(log_path)


#: Answers up to this many rows are broadcast; beyond, a text's cells are spread over SALTS tasks.
BROADCAST_ANSWERS, SALTS = 100_000, 32


def apply(routed: DataFrame, answers: DataFrame) -> DataFrame:
    """Routed cells with their type after answers, and how it came about: guided, kept (answered none) or pending
    (no answer, or one that the cell may not take). One text may have a third of all cells: few answers are
    broadcast, many are joined to cells salted by table."""
    named = answers.withColumnRenamed("rule_type", "type")
    if answers.count() <= BROADCAST_ANSWERS:
        found = routed.join(F.broadcast(named), ["text", "type"], "left")
    else:
        spread = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = routed.withColumn("salt", F.pmod(F.xxhash64("table_uid", "cell_id"), F.lit(SALTS)).cast("int"))
        found = salted.join(spread, ["text", "type", "salt"], "left").drop("salt")
    taken = F.array_contains(F.split("allowed", "\\|"), F.col("answer"))
    how = F.when(taken, "guided").when(F.col("answer") == "none", "kept").otherwise("pending")
    return found.withColumn("derivation", how).withColumn("guided_type", F.when(F.col("derivation") == "guided", F.col("answer")).otherwise(F.col("type")))


# The wording of a request to a model.
OPENING = 'You assign types to cells taken from tables in scientific papers. {} For each cell choose the one allowed type whose description fits it best, or "none" if none of its allowed types fits. Decide from the cell text alone; you do not see the rest of the table.'
ALIKE = "Each cell below has an id and its text, and it may take any of the types listed."
APART = "Each cell below has an id, its text and the types it may take."
CLOSING = 'Answer with a JSON object that maps every cell id to one of that cell\'s allowed types or to "none", for example {{"1": "{}", "2": "none"}}.'


def prompts(batched: DataFrame, program: Program) -> DataFrame:
    """(batch_id, prompt): the program's types with their descriptions, a type's own joined by '; or ', then the
    batch's items in order, each with its own list of types only where the items' lists differ."""
    types = list(dict.fromkeys(t for _, t in program.guidelines))
    said = "\n".join(f"- {t}: " + "; or ".join(d for d, u in program.guidelines if u == t) for t in types)
    quoted = lambda s: F.regexp_replace(F.to_json(F.struct(s["text"].alias("t"))), "(?s)^\\{\"t\":(.*)\\}$", "$1")
    line = lambda s, own: F.concat(s["item"].cast("string"), F.lit(". "), quoted(s), F.when(own, F.concat(F.lit(" (allowed: "), F.replace(s["allowed"], F.lit("|"), F.lit(", ")), F.lit(")"))).otherwise(""))
    items = batched.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("item", "text", "allowed"))).alias("items"), F.countDistinct("allowed").alias("n"))
    opening = F.when(F.col("n") > 1, OPENING.format(APART)).otherwise(OPENING.format(ALIKE))
    cells = F.array_join(F.transform("items", lambda s: line(s, F.col("n") > 1)), "\n")
    return items.select("batch_id", F.concat(opening, F.lit(f"\n\nTypes:\n{said}\n\nCells:\n"), cells, F.lit("\n\n" + CLOSING.format(types[0] if types else ""))).alias("prompt"))


def replies(batched: DataFrame, given: DataFrame) -> DataFrame:
    """One row per item of a batch with a reply: batch_id, item, text, rule_type, answer (null: missing), n_missing of
    the batch, and retry, the reason why nothing of the reply is of use, if so. given: batch_id, reply (JSON text)."""
    read = F.from_json("reply", "map<string,string>")
    by_item = batched.join(given.select("batch_id", "reply", read.alias("read")), "batch_id")
    value = F.trim(F.regexp_replace(F.try_element_at("read", F.col("item").cast("string")), "\\s+", " "))
    allowed = (value == "none") | F.array_contains(F.split("allowed", "\\|"), value)
    of_batch = W.partitionBy("batch_id")  # at most BATCH items
    out = by_item.withColumn("answer", F.when(allowed, value)).withColumn("n_missing", F.count_if(F.col("answer").isNull()).over(of_batch))
    retry = (
        F.when(F.col("reply").isNull(), "the model call failed or returned nothing").when(F.col("read").isNull(), "the answer is not a JSON object")
        .when(F.col("n_missing") == F.count("*").over(of_batch), 'no cell got one of its allowed types or "none"')
    )
    return out.select("batch_id", "item", "text", "rule_type", "answer", F.col("n_missing").cast("int").alias("n_missing"), retry.alias("retry"))
