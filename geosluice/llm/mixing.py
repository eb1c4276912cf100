"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code point order, null last, weigh `weights` in rotation and
share `budget` times all words; no target passes `most` times its source, and
what is over is reshared by weight.  Filling sources by rising room per weight
gives the end of that resharing in one pass.

Order: within a source, documents follow an md5 of their id (of the text, if they have none), and the stream of
their words, repeated, is taken up to the target.  The prefix sums behind it are
made in two levels, sums of hash ranges and then places within a range, so the
largest source is dealt over thousands of groups.

Curriculum: each source has a schedule of weights over training time 0..1,
piecewise linear between knots.  Integrated and scaled to the target it is the
source's cumulative token demand; its inverse, a quadratic within a piece,
gives the time at which a word offset is due.  Documents are range-sorted by it.

Everything is DataFrame functions; windows without a partition see one row per
source only.  Cases: null text has size 0; a null source is a source; size 0 is
taken 0 and has no position; a row without doc_id sorts by its text, so many such rows
are many ranges; rows with equal doc_id are documents each; no words at all make all
targets 0; only the numbers of words of a text are kept, however long it is; extra
columns are ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2
#: Hash ranges of a source: three hexadecimal digits.
RANGE_DIGITS = 3
#: Default schedules by weight: knots (time, weight); heavier sources come early, light ones late.
SCHEDULES = {5: ((0.0, 1.5), (1.0, 0.5)), 2: ((0.0, 1.0), (1.0, 1.0)), 1: ((0.0, 0.2), (0.5, 0.6), (1.0, 2.2))}
WORD = "[^\\x20\\x09-\\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.coalesce(F.col("text").cast("string"), F.lit("")))).cast("binary")).alias("order")
    return docs.select(order, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """source, source_size, weight, target: one row per source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("room", F.lit(float(most)) * F.col("source_size"))
    rising = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("left", F.lit(budget) * F.sum("source_size").over(everything) - F.coalesce(F.sum("room").over(before), F.lit(0.0)))
    per = per.withColumn("weights_left", F.sum("weight").over(after))
    per = per.withColumn("full", F.col("left") * F.col("weight") / F.col("weights_left") >= F.col("room"))
    # the first source that is not full fixes the level for all that follow
    level = F.min(F.when(~F.col("full"), F.struct(F.col("room") / F.col("weight"), F.col("left") / F.col("weights_left")))).over(everything)
    per = per.withColumn("level", level["col2"])
    target = F.when(F.col("full"), F.col("room")).otherwise(F.col("level") * F.col("weight"))
    return per.select("source", "source_size", F.col("weight").cast("int").alias("weight"), F.coalesce(target, F.lit(0.0)).alias("target"))


def pieces_of(knots) -> list[dict]:
    """Pieces of a schedule with its integral scaled to 1: begin, end, weights there, share before and after."""
    total = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
    out, at = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area = (t1 - t0) * (w0 + w1) / 2 / total
        out.append({"t0": t0, "dt": t1 - t0, "w0": w0 / total, "w1": w1 / total, "c0": at, "c1": at + area})
        at += area
    return out


def due(share: Column, knots) -> Column:
    """The time by which `share` (0..1) of a source's demand has come: the schedule's integral inverted."""
    out, parts = F.lit(float(knots[-1][0])), pieces_of(knots)
    for p in reversed(parts):
        slope, need = (p["w1"] - p["w0"]) / p["dt"], F.greatest(share - F.lit(p["c0"]), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(p["w0"] ** 2) + need * (2 * slope), F.lit(0.0)))
        u = F.when(need <= 0, F.lit(0.0)).otherwise(need * 2 / (root + p["w0"]))
        out = F.when(share < p["c1"], F.lit(p["t0"]) + F.least(u, F.lit(p["dt"]))).otherwise(out)
    return out


def mix(docs: DataFrame, weights=WEIGHTS, budget=BUDGET, most=MOST, schedules=SCHEDULES) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the times (0..1) of a document's first and second
    reading, null if there is none; sorted by the first."""
    sized = cut(sizes(docs).withColumn("range", F.substring("order", 1, RANGE_DIGITS)), "sizes")
    goal = cut(targets(sized, weights, budget, most), "targets")
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    ranges = ranges.join(goal, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    placed = sized.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    within = Window.partitionBy("source", "range").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("end", F.col("base") + F.sum("size").over(within)).withColumn("begin", F.col("end") - F.col("size"))
    goal_words = F.floor(F.col("target") + 0.5)
    taken, times = F.lit(0), []
    for lap in range(most):
        begin = F.col("begin") + F.col("source_size") * lap
        part = F.greatest(F.least(begin + F.col("size"), goal_words) - begin, F.lit(0))
        taken = taken + part
        share = F.try_divide(begin.cast("double"), goal_words)
        time = F.lit(None).cast("double")
        for w in weights:
            time = F.when(F.col("weight") == w, due(share, schedules[w])).otherwise(time)
        times.append(F.when(part > 0, time).alias(f"position_{lap + 1}"))
    out = placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *times)
    return out.orderBy(F.col("position_1").asc_nulls_last(), "doc_id")


def op4_mixing(spark, sf_dir) -> DataFrame:
    """Beside the contract's columns, the training times of a document's first and second reading, to nine digits."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", *[F.round(f"position_{lap}", 9).alias(f"position_{lap}") for lap in (1, 2)])


ORACLE = """
WITH d AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, 2.0::DOUBLE * source_size AS room,
         CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight FROM s
), l AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(room) OVER (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         sum(weight) OVER (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left FROM w
), f AS (SELECT *, remaining * weight / weights_left >= room AS is_full FROM l),
t AS (
  SELECT source, source_size,
         coalesce(CASE WHEN is_full THEN room ELSE weight * (SELECT min(struct_pack(a := room / weight, b := remaining / weights_left)) FROM f WHERE NOT is_full).b END, 0) AS target FROM f
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, w.weight, floor(t.target + 0.5) AS goal,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null' || coalesce(d.text, ''))), d.size ROWS UNBOUNDED PRECEDING) - d.size AS begin_1
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN w ON d.source IS NOT DISTINCT FROM w.source
), q AS (
  SELECT *, greatest(least(begin_1 + size, goal) - begin_1, 0) AS part_1, greatest(least(begin_1 + source_size + size, goal) - begin_1 - source_size, 0) AS part_2,
         CAST(begin_1 AS DOUBLE) / nullif(goal, 0) AS share_1, CAST(begin_1 + source_size AS DOUBLE) / nullif(goal, 0) AS share_2
  FROM p
)
SELECT doc_id, size, source_size, target, CAST(part_1 + part_2 AS BIGINT) AS taken,
       -- weights over time t: 1.5 - t for sources that weigh 5, even for 2, and for 1 rising from 0.2 over 0.6 at one half to 2.2,
       -- whose integrals are solved for the time at which a share of them is reached
       round(CASE WHEN part_1 <= 0 THEN NULL WHEN weight = 5 THEN 1.5 - sqrt(2.25 - 2 * share_1) WHEN weight = 2 THEN share_1
                  WHEN share_1 * 0.9 < 0.2 THEN (sqrt(0.04 + 1.6 * 0.9 * share_1) - 0.2) / 0.8
                  ELSE 0.5 + (sqrt(0.36 + 6.4 * (0.9 * share_1 - 0.2)) - 0.6) / 3.2 END, 9) AS position_1,
       round(CASE WHEN part_2 <= 0 THEN NULL WHEN weight = 5 THEN 1.5 - sqrt(2.25 - 2 * share_2) WHEN weight = 2 THEN share_2
                  WHEN share_2 * 0.9 < 0.2 THEN (sqrt(0.04 + 1.6 * 0.9 * share_2) - 0.2) / 0.8
                  ELSE 0.5 + (sqrt(0.36 + 6.4 * (0.9 * share_2 - 0.2)) - 0.6) / 3.2 END, 9) AS position_2
FROM q
"""
