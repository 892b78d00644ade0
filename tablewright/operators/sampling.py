"""Splits and samples that any run repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TABLE = "table_uid"


def split(article: Column) -> Column:
    """dev or test: the last 15 hexadecimal digits of the SHA-1 of the article's id, modulo 10, below 4 is dev."""
    digits = F.conv(F.substring(F.sha1(article), 26, 15), 16, 10).cast("long")
    return F.when(digits % 10 < 4, "dev").otherwise("test")


def lot(seed: int, uid: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), uid))


def sampling_pool(tables: DataFrame, gold: DataFrame, classes: DataFrame, max_slots: int) -> DataFrame:
    """Tables with a gold candidate and at most max_slots places, with their class, simple where none is given.
    tables: table_uid, pmc_id, n_slots; gold: table_uid, gold_candidate; classes: table_uid, class."""
    known = gold.where("gold_candidate IS NOT NULL").select(TABLE, "gold_candidate")
    pool = tables.where(F.col("n_slots") <= max_slots).join(known, TABLE).join(classes.select(TABLE, "class"), TABLE, "left")
    return pool.withColumn("class", F.coalesce("class", F.lit("simple")))


def by_lot(seed: int) -> list[Column]:
    return [lot(seed, F.col(TABLE)), F.col(TABLE)]


def quota(pool: DataFrame, stratum: str, quotas: dict[str, int], seed: int, used: DataFrame | None = None) -> DataFrame:
    """Exactly as many tables of each stratum as its quota, in lot order, the strata in the order of `quotas`. An article
    of which a table was drawn, here or in `used` (pmc_id), serves no later stratum. A stratum with too few tables is an
    error. Only the drawn tables, as many as the quotas say, are held on the driver between strata."""
    drawn, closed = [], None if used is None else used.select("pmc_id").distinct()
    for name, n in quotas.items():
        mine = pool.where(F.col(stratum) == name)
        mine = mine if closed is None else mine.join(closed, "pmc_id", "left_anti")
        taken = mine.orderBy(*by_lot(seed)).limit(n).collect()
        if len(taken) < n:
            raise ValueError(f"only {len(taken)} {name} tables can be drawn, not {n}")
        one = pool.sparkSession.createDataFrame(taken, mine.schema).select(*pool.columns)
        drawn.append(one)
        new = one.select("pmc_id").distinct()
        closed = new if closed is None else closed.unionByName(new)
    out = drawn[0]
    for one in drawn[1:]:
        out = out.unionByName(one)
    return out


def round_robin(pool: DataFrame, stratum: str, order: list[str], n: int, seed: int, used: DataFrame | None = None) -> DataFrame:
    """n tables with their `place`: the strata take turns in `order`, each taking its next table by lot of an article
    that has none yet, here or in `used`; a stratum without one is passed over, and it is an error if all are.

    A stratum's picks are among the first 2n of its articles, since at most n go to others: so much of each, best
    tables by lot, reaches the driver, where the turns are played."""
    open_ = pool.where(F.col(stratum).isin(*order))
    open_ = open_ if used is None else open_.join(used.select("pmc_id").distinct(), "pmc_id", "left_anti")
    first = open_.groupBy(stratum, "pmc_id").agg(F.min(F.struct(lot(seed, F.col(TABLE)).alias("lot"), F.col(TABLE))).alias("best"))
    row = F.row_number().over(W.partitionBy(stratum).orderBy("best"))
    queues: dict[str, list] = {name: [] for name in order}
    for r in first.withColumn("row", row).where(F.col("row") <= 2 * n).select(stratum, "pmc_id", "row", F.col(f"best.{TABLE}").alias(TABLE)).collect():
        queues[r[stratum]].append((r["row"], r["pmc_id"], r[TABLE]))
    turns = {name: iter(sorted(queue)) for name, queue in queues.items()}
    closed: set[str] = set()
    picked: list[tuple[str, int]] = []
    while len(picked) < n:
        before = len(picked)
        for name in order:
            if len(picked) < n and (found := next((q for q in turns[name] if q[1] not in closed), None)):
                closed.add(found[1])
                picked.append((found[2], len(picked)))
        if len(picked) == before:
            raise ValueError(f"only {len(picked)} of {n} tables can be drawn")
    places = pool.sparkSession.createDataFrame(picked, f"{TABLE} string, place int")
    return pool.join(F.broadcast(places), TABLE)


def next_batch(pool: DataFrame, earlier: DataFrame, stratum: str, order: list[str], n: int, seed: int) -> DataFrame:
    """A round robin over the articles of which no earlier sample has a table."""
    return round_robin(pool, stratum, order, n, seed, earlier)


def first_new(found: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """(id, query_rank, place): the first `most` results of each query that are not known and that no earlier query
    kept. found: query_rank, rank, id. With q queries, a query's are among its first q x most new results; so many of
    each reach the driver."""
    fresh = found.join(known.select("id").distinct(), "id", "left_anti").groupBy("query_rank", "id").agg(F.min("rank").alias("rank"))
    queries = [r[0] for r in fresh.select("query_rank").distinct().orderBy("query_rank").collect()]
    place = F.row_number().over(W.partitionBy("query_rank").orderBy("rank", "id"))
    first: dict = {q: [] for q in queries}
    for r in fresh.withColumn("place", place).where(F.col("place") <= len(queries) * most).collect():
        first[r["query_rank"]].append((r["place"], r["id"]))
    kept: dict = {}
    for q in queries:
        new = [i for _, i in sorted(first[q]) if i not in kept][:most]
        kept |= {i: (q, k) for k, i in enumerate(new, 1)}
    schema = f"id {found.schema['id'].dataType.simpleString()}, query_rank {found.schema['query_rank'].dataType.simpleString()}, place int"
    return found.sparkSession.createDataFrame([(i, q, k) for i, (q, k) in kept.items()], schema)


def first_with_tables(articles: DataFrame, most: int) -> DataFrame:
    """The first ranked articles that have tables. articles: pmc_id, rank, n_tables."""
    return articles.where("n_tables > 0").orderBy("rank", "pmc_id").limit(most)
