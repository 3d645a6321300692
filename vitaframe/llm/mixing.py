"""Mixing sources to target weights: rates per source, whole repeats plus one hash-seeded Bernoulli copy.

Built-in functions only. Words are counted once per text and ``(id, source, size)`` is written; all
sums are combined before the shuffle, so a source with a third of all rows is one row per task. The
sources' table stays a table: it is ranked with offsets of its sorted partitions, and targets come
from a few scalar sums. Rows meet their source in an ordinary join, which Spark broadcasts while the
sources' table is small and whose skewed partitions it may split otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaframe.llm.common import packed, unpacked, written

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 42
#: Draws per document; a source uses the one whose taken words come nearest its target.
DRAWS = 16


def n_words(text: Column) -> Column:
    """Number of runs of other characters than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draws(id_col: Column, seed: int) -> Column:
    """``DRAWS`` numbers from 0 up to 1 of a document, from SHA-256 of seed and id (null: the word null)."""
    name = F.coalesce(id_col.cast("string"), F.lit("null"))
    digest = F.concat(*[F.sha2(F.concat(F.lit(f"{seed}:{part}:"), name), 256) for part in range(DRAWS // 8)])
    return F.transform(
        F.array(*[F.substring(digest, 8 * k + 1, 8) for k in range(DRAWS)]), lambda h: F.conv(h, 16, 10).cast("double") / F.lit(float(1 << 32))
    )


def _ranked(sources: DataFrame) -> DataFrame:
    """``rank`` from 0 in code-point order, null last, without one task that sees all sources."""
    ordered = written(sources.orderBy(F.asc_nulls_last("source")).withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row per sorted partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", before.alias("before"))
    return ordered.withColumn("part", part).join(offsets, "part").withColumn("rank", F.col("before") + place).drop("part", "before", "at")


def source_plan(slim: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``source, source_size, target, rate, draw`` per source of ``slim`` (``id, source, size``).

    All sizes together are shared by weight. A target stops at ``most`` times its source's size; what
    is over is shared among the others by weight, until no target is above. A source without words
    has target and rate 0.
    """
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    wheel = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = written(_ranked(sources).withColumn("weight", F.get(wheel, (F.col("rank") % len(weights)).cast("int"))), "mix-ranked")
    cap = F.col("source_size") * most
    full, capped = F.lit(False), -1
    share = 0.0
    while True:  # each pass finds at least one more source at its cap
        sums = ranked.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("at_cap"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"),
            F.count(F.when(full, 1)).alias("capped"),
        ).first()
        if sums.capped == capped:
            break
        capped = sums.capped
        share = (sums.total - sums.at_cap) / sums.weight if sums.weight else 0.0
        full = F.col("weight") * F.lit(share) > cap
    target = F.when(full, cap.cast("double")).otherwise(F.col("weight") * F.lit(share))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    planned = ranked.select("source", "source_size", target.alias("target"), rate.alias("rate"))
    # the words that each draw would take, summed in the map tasks first
    trial = _with_plan(slim, planned).withColumn("d", draws(F.col("id"), seed))
    sums = trial.groupBy("source").agg(
        *[F.sum(F.col("size") * _copies(F.col("rate"), F.col("d")[k])).alias(f"t{k}") for k in range(DRAWS)]
    )
    off = F.array(*[F.abs(F.col(f"t{k}") - F.col("target")) for k in range(DRAWS)])
    both = planned.join(sums.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    nearest = (F.array_position(off, F.array_min(off)) - 1).cast("int")
    return written(both.select("source", "source_size", "target", "rate", nearest.alias("draw")), "mix-plan")


def _copies(rate: Column, draw: Column) -> Column:
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _with_plan(rows: DataFrame, plan: DataFrame, source: str = "source") -> DataFrame:
    other = plan.withColumnRenamed("source", "_plan_source")
    return rows.join(other, F.col(source).eqNullSafe(F.col("_plan_source"))).drop("_plan_source")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))


def mixed(slim: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row per row of ``slim``: ``id, source, size, source_size, target, copies, taken``.

    Reruns agree, as draws depend on seed and id alone; rows that repeat an id share its draws.
    """
    slim = written(slim, "mix-sizes")
    rows = _with_plan(slim, source_plan(slim, weights, most, seed))
    copies = _copies(F.col("rate"), F.get(draws(F.col("id"), seed), F.col("draw")))
    out = rows.withColumn("copies", copies)
    return out.select("id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as the mix takes it (not at all, once or more).

    A null source is a source of its own, a null text counts no words and follows its source's rate.
    An empty table stays empty.
    """
    plan = source_plan(written(sizes(docs, id_col, text_col, source_col), "mix-sizes"), weights, most, seed)
    keyed = packed(docs, _source=F.col(f"`{source_col}`"), _id=F.col(f"`{id_col}`"))
    rows = _with_plan(keyed, plan.select("source", "rate", "draw"), "_source")
    copies = _copies(F.col("rate"), F.get(draws(F.col("_id"), seed), F.col("draw")))
    repeated = rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))))
    return unpacked(repeated, docs.columns)
