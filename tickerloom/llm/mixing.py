"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickerloom.session import durable_table

WORD = r"[^\x20\x09-\x0D]+"
#: Slots of a source's shuffled order, and steps of virtual time per round of refinement.
SLOT_HEX = 3
STEPS = 4096
#: Rows that are alike are told out in lists of at most this length.
LIST = 65536


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")


def _mark() -> Column:
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("mark")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """(source, source_size) -> with target: ``share`` of all sizes dealt by weight, none above ``repeats`` times its size.

    One row per source goes in; the windows here hold the sources only. A source
    stops at its cap where cap / weight lies below the common level; sorted by
    that ratio, the level of each prefix follows from what is left.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    by_ratio = Window.orderBy("ratio", "place")
    ranked = (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * repeats)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    levels = ranked.withColumn(
        "level",
        (F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
    )
    free = F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "place", "level"))
    level = F.coalesce(F.min(free).over(Window.partitionBy())["level"], F.lit(0.0))
    return levels.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * level)).select("source", "place", "source_size", "target")


def mix_sources(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    repeats: int = 2,
) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies, taken, mark.

    A document's size is its number of words, ``mark`` the md5 of its text. Each
    source's documents are shuffled by the md5 of doc_id, or of ``mark`` where
    that is null; ties go by size and mark, and rows alike in all of these stand
    one after the other, each with a place of its own. Copy k of a document
    finishes at virtual time (k * source_size + words up to and
    with it) / target. All copies are taken in the order of virtual time, then
    source, then shuffle, while their words stay within the sum of targets.
    ``copies`` says how often the mix takes the document.

    Null or empty text: size 0, never taken. Null source: a source of its own,
    ranked last. Null doc_id: shuffled by the text. Repeated rows count as
    often as they stand, and the mix may take some of them and leave others;
    they are one row, with their number, until they have their places. Empty
    table: empty result. Other columns of ``docs``
    play no part, whatever their names.
    """
    # read again three times below, so counted once; copies that are alike in all columns travel as one row
    rows = durable_table(docs.select("doc_id", "source", _size(), _mark()).groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("alike")))
    rows = rows.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), "mark"))).withColumn("slot", F.substring("key", 1, SLOT_HEX))

    slots = rows.groupBy("source", "slot").agg(F.sum(F.col("size") * F.col("alike")).alias("slot_size"))
    targets = source_targets(slots.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, share, repeats)
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slots.withColumn("offset", F.coalesce(F.sum("slot_size").over(before), F.lit(0)))
        .withColumnRenamed("source", "s")
        .join(targets, F.col("s").eqNullSafe(F.col("source")))
        .select(F.col("s").alias("o_source"), F.col("slot").alias("o_slot"), "offset", "place", "source_size", "target")
    )
    upto = Window.partitionBy("source", "slot").orderBy("key", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    placed = durable_table(
        rows.withColumn("within", F.coalesce(F.sum(F.col("size") * F.col("alike")).over(upto), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("slot") == F.col("o_slot")))
        .withColumn("list", F.explode(F.expr(f"sequence(0, (alike - 1) div {LIST})")))
        .withColumn("no", F.explode(F.expr(f"sequence(list * {LIST} + 1, least(alike, (list + 1) * {LIST}))")))
        .select("doc_id", "source", "size", "mark", "key", "place", "source_size", "target",
                (F.col("offset") + F.col("within") + F.col("size") * F.col("no")).alias("upto"))
    )

    def finish(copy: Column) -> Column:
        return F.try_divide(copy * F.col("source_size") + F.col("upto"), F.col("target"))

    copies = (
        placed.where("size > 0 AND target > 0")
        .withColumn("copy", F.explode(F.array(*[F.lit(k) for k in range(repeats)])))
        .withColumn("time", finish(F.col("copy")))
        .withColumn("tick", F.floor(F.col("time") * (STEPS * STEPS)))
        .withColumn("slice", F.floor(F.col("time") * STEPS))
    )
    budget = targets.agg(F.sum("target").alias("budget"))

    def cut(groups: DataFrame, name: str, base: Column) -> DataFrame:
        """The first group of ``name`` that goes beyond the budget, and the words before it."""
        running = groups.withColumn("through", base + F.sum("words").over(Window.orderBy(name)))
        return running.where(F.col("through") > budget.scalar()).agg(F.min(F.struct(F.col(name).alias("at"), (F.col("through") - F.col("words")).alias("taken"))).alias("c"))

    # ``slice`` and ``tick`` grow with time; each table below has at most repeats * STEPS rows near the cut
    slices = durable_table(cut(copies.groupBy("slice").agg(F.sum("size").alias("words")), "slice", F.lit(0)))
    at_slice = slices.select("c.at").scalar()
    in_slice = copies.where(F.col("slice") == at_slice)
    ticks = durable_table(cut(in_slice.groupBy("tick").agg(F.sum("size").alias("words")), "tick", slices.select("c.taken").scalar()))
    at_tick = ticks.select("c.at").scalar()
    order = [F.col(c) for c in ("time", "place", "key", "size", "copy")]
    last = (
        in_slice.where(F.col("tick") == at_tick)
        .withColumn("through", ticks.select("c.taken").scalar() + F.sum("size").over(Window.orderBy(*order)))
        .where(F.col("through") <= budget.scalar())
        .agg(F.max(F.struct(*order)).alias("m"))
    )
    bound = durable_table(
        slices.select(F.col("c.at").alias("slice"))
        .withColumn("tick", at_tick)
        .withColumn("m", last.scalar())
    )
    bound_of = bound.select(F.struct("slice", "tick", "m").alias("b")).scalar()

    def taken(copy: int) -> Column:
        time = finish(F.lit(copy))
        tick, piece = F.floor(time * (STEPS * STEPS)), F.floor(time * STEPS)
        here = F.struct(time.alias("time"), F.col("place"), F.col("key"), F.col("size"), F.lit(copy).alias("copy"))
        inside = (
            F.col("b.slice").isNull()
            | (piece < F.col("b.slice"))
            | ((piece == F.col("b.slice")) & (F.col("b.tick").isNull() | (tick < F.col("b.tick")) | ((tick == F.col("b.tick")) & F.col("b.m").isNotNull() & (here <= F.col("b.m")))))
        )
        return F.when((F.col("size") > 0) & (F.col("target") > 0) & inside, 1).otherwise(0)

    marked = placed.withColumn("b", bound_of).withColumn("copies", sum((taken(k) for k in range(1, repeats)), taken(0)))
    return marked.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "mark")


def mixed_documents(docs: DataFrame, *, repeats: int = 2, **options) -> DataFrame:
    """The rows of ``docs`` the mix takes, each as often as it is taken, with the columns of ``docs``.

    Of rows alike in id, source and text of which the mix takes some only, these
    are the first by a hash of the whole row.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    same = ("doc_id", "source", "size", "mark")
    rows = docs.select(F.struct(*names).alias("row"), "doc_id", "source", _size(), _mark()).withColumnsRenamed({c: f"k_{c}" for c in same})
    there = [F.col(f"k_{c}").eqNullSafe(F.col(c)) for c in same]
    levels = [f"at{k}" for k in range(1, repeats + 1)]
    verdict = mix_sources(docs, repeats=repeats, **options).groupBy(*same).agg(
        F.count("*").alias("alike"), *[F.count_if(F.col("copies") >= k).alias(c) for k, c in enumerate(levels, 1)]
    )
    verdict = durable_table(verdict.where("at1 > 0"))
    whole = " AND ".join(f"({c} = 0 OR {c} = alike)" for c in levels)

    def told_out(joined: DataFrame, copies: Column) -> DataFrame:
        return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select("row.*")

    out = told_out(rows.join(verdict.where(whole), there), sum((F.col(c) > 0).cast("int") for c in levels))
    # the cut goes through at most one group of rows alike a source and copy
    parted = durable_table(verdict.where(f"NOT ({whole})"))
    if parted.isEmpty():
        return out
    place = F.row_number().over(Window.partitionBy(*same).orderBy(F.xxhash64(F.to_json("row"))))
    some = rows.join(parted, there).withColumn("no", place).where("no <= at1")
    return out.union(told_out(some, sum((F.col("no") <= F.col(c)).cast("int") for c in levels)))


def op2_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(coalesce(text, '')) AS mark, md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS key,
         row_number() OVER () AS row
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, 2 * source_size AS cap, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM s)
), l AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS ratio,
    (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
       - coalesce(CAST(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
    / CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM r
), t AS (
  SELECT source, place, source_size,
         least(CAST(cap AS DOUBLE), weight * coalesce((SELECT arg_min(level, {'r': ratio, 'p': place}) FROM l WHERE ratio > level), 0)) AS target
  FROM l
), p AS (
  SELECT d.*, t.place, t.source_size, t.target,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, size, mark, row ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT p.*, copy, CAST(copy * source_size + upto AS DOUBLE) / target AS time
  FROM p, (VALUES (0), (1)) AS k(copy) WHERE size > 0 AND target > 0
), g AS (
  SELECT *, sum(size) OVER (ORDER BY time, place, key, size, copy) AS through FROM c
), n AS (
  SELECT row, count(*) AS copies FROM g WHERE through <= (SELECT sum(target) FROM t) GROUP BY row
)
SELECT p.doc_id, p.source, CAST(p.size AS BIGINT) AS size, p.source_size, p.target,
       CAST(p.size * coalesce(n.copies, 0) AS BIGINT) AS taken
FROM p LEFT JOIN n ON p.row = n.row
"""
