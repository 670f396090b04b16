"""Mixing sources to target weights by weighted fair queueing; DataFrame operations only.

Every document of a source stands in a shuffled queue (by a hash of its doc_id), at most `max_epochs` times over.
An occurrence's virtual finish time is its source's cumulative words divided by the source's target, so all
sources advance at rates in proportion to their targets. Occurrences are taken in order of finish time up to the
total budget; equal finish times are taken together or not at all.

Targets share the budget by weight, but none exceeds `max_epochs` times its source's words; what is above goes to
the others by weight (water filling, solved in closed form over the table of sources).

Defined cases: a null source is a source of its own, ordered last; a null or empty text has size 0 and is taken 0
words; a null doc_id shuffles as an empty string; repeated rows count separately; an empty table gives no rows.
Columns of `docs` named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm._store import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Documents in a bucket of a source's queue; prefix sums run over buckets first, then inside each.
BUCKET_ROWS = 1000
#: The finish-time axis is cut into at least so many slices to find where the budget ends.
LEAST_SLICES = 1024
RESULT = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, text: str, source: str, doc_id: str) -> DataFrame:
    """Adds _size, _src (a key in which null is a value) and _pos in [0, 1), the place in the shuffled queue."""
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return (
        docs.withColumn("_size", word_count(F.col(text)))
        .withColumn("_src", F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")))
        .withColumn("_pos", F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52)))
    )


def _targets(sources: DataFrame, weights: Sequence[float], max_epochs: int, budget: int | None) -> DataFrame:
    """One row per source with _target. A source is capped if its cap per weight is below the final rate."""
    everything = W.partitionBy(F.lit(0))
    named = W.partitionBy(F.lit(0)).orderBy(F.col("_src").startswith("n"), F.col("_src"))
    by_ratio = W.partitionBy(F.lit(0)).orderBy("_ratio", "_src")
    upto = by_ratio.rowsBetween(W.unboundedPreceding, W.currentRow)
    rank = (F.row_number().over(named) - 1) % len(weights)
    weighed = sources.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))).withColumn("_cap", F.col("_total") * max_epochs)
    weighed = weighed.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    total = F.least(F.lit(budget).cast("long"), F.sum("_cap").over(everything)) if budget is not None else F.sum("_total").over(everything)
    filled = (
        weighed.withColumn("_budget", total)
        .withColumn("_caps", F.sum("_cap").over(upto) - F.col("_cap"))
        .withColumn("_rest", F.sum("_w").over(everything) - F.sum("_w").over(upto) + F.col("_w"))
        .withColumn("_rate", (F.col("_budget") - F.col("_caps")) / F.col("_rest"))  # if all before this one are capped
        .withColumn("_open", F.col("_ratio") >= F.col("_rate"))
    )
    rate = F.min(F.when(F.col("_open"), F.struct("_ratio", "_src", "_rate"))).over(everything)["_rate"]
    return filled.withColumn("_final", rate).withColumn("_target", F.when(F.col("_ratio") >= F.col("_final"), F.col("_w") * F.col("_final")).otherwise(F.col("_cap").cast("double"))).select("_src", "_n", "_total", "_target", "_budget")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: int = 3, budget: int | None = None, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """`docs` with size, source_size, target (of its source), copies (times taken) and taken (words, repeats counted).

    Weights go to sources in order of name, repeating; the budget is all words unless given. The sources' totals
    and the buckets' sums come from one narrow pass; the rows themselves are shuffled once, by bucket, where the
    join with the buckets' offsets and the running sum share the partitioning. A hot source is many buckets.
    """
    docs = docs.drop(*RESULT)
    narrow = stored(_keyed(docs.select(doc_id, source, text), text, source, doc_id).select("_src", "_pos", "_size"), "mix-sizes")
    targets = stored(_targets(narrow.groupBy("_src").agg(F.count("*").alias("_n"), F.sum("_size").alias("_total")), weights, max_epochs, budget), "mix-targets")

    def bucketed(rows: DataFrame) -> DataFrame:
        return rows.join(targets, "_src").withColumn("_bucket", F.floor(F.col("_pos") * F.ceil(F.col("_n") / BUCKET_ROWS)))

    sums = bucketed(narrow).groupBy("_src", "_bucket").agg(F.sum("_size").alias("_sum"))
    before = W.partitionBy("_src").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("_src", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("_src", "_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)

    def queued(rows: DataFrame, *ties: str) -> DataFrame:
        placed = bucketed(rows).join(offsets, ["_src", "_bucket"])
        cum = F.col("_offset") + F.sum("_size").over(inside.orderBy("_pos", *ties))
        epochs = [F.when(F.col("_target") > 0, (F.lit(e) * F.col("_total") + cum) / F.col("_target")).otherwise(F.lit(0.0)) for e in range(max_epochs)]
        return placed.withColumn("_finish", F.array(*epochs))

    finish = queued(narrow, "_size").select("_size", "_budget", F.explode("_finish").alias("_v"))
    last = _cut(finish, narrow)
    out = queued(_keyed(docs, text, source, doc_id), "_size")
    copies = F.when(F.col("_size") > 0, F.size(F.filter("_finish", lambda v: v <= F.lit(last)))).otherwise(F.lit(1))
    return out.select(
        *docs.columns, F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"),
        copies.cast("int").alias("copies"), (F.col("_size") * copies).cast("long").alias("taken"),
    )


def _cut(finish: DataFrame, narrow: DataFrame) -> float:
    """The largest finish time up to which all occurrences together fit the budget.

    Slices of the time axis are summed first; only the slice in which the budget ends is sorted. Only the number
    of that slice and the sum before it reach the driver.
    """
    slices = max(LEAST_SLICES, narrow.count() // BUCKET_ROWS)
    sliced = finish.withColumn("_slice", F.floor(F.least(F.col("_v"), F.lit(4.0)) * slices))
    sums = sliced.groupBy("_slice").agg(F.sum("_size").alias("_s"), F.max("_budget").alias("_b"))
    running = sums.withColumn("_run", F.sum("_s").over(W.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(W.unboundedPreceding, W.currentRow)))
    over = running.where("_run > _b").agg(F.min(F.struct("_slice", (F.col("_run") - F.col("_s")).alias("_base"), "_b")).alias("x")).first()["x"]
    if over is None:
        return float("inf")
    tied = W.partitionBy(F.lit(0)).orderBy("_v").rangeBetween(W.unboundedPreceding, W.currentRow)
    fits = sliced.where(F.col("_slice") == over["_slice"]).withColumn("_run", F.sum("_size").over(tied) + over["_base"]).where(F.col("_run") <= over["_b"])
    best = fits.agg(F.max("_v")).first()[0]
    return best if best is not None else float(over["_slice"]) / slices - 1e-12


def take_copies(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as it is taken, without the counts."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("_copy", *RESULT)
