"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions alone.

Every document is shuffled by a keyed digest. Its virtual finish time is the running number of words of its source divided by the target of
the source; a second pass over the source follows the first. All (document, pass) entries are sorted by finish time and cut where
their words reach the total budget.

No group is gathered in a task: running sums are taken in two levels (sums of digest ranges, then rows within a range), and the cut is found
digit by digit of the finish time: sums of 4,096 ranges, then of 4,096 parts of the range that holds the cut, until that is a few entries, which are sorted.

Edges: null text has size 0; null source is a source of its own, last in order; a document without words takes part with 0; repeated rows are
documents of their own; an empty table gives an empty result. A source without words has target 0. Ties in the digest are broken by doc_id
and size; rows equal in all three are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortica.llm.common import cut, n_words

WEIGHTS = (5, 2, 1)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """One row per source: source, source_size, weight, target. Targets are least(most * size, level * weight), the level such that they add up to share * all sizes.

    The windows without partition run over one row per source, never over documents.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", w).withColumn("full", F.col("source_size") * most / F.col("weight"))
    order = Window.orderBy("full", F.asc_nulls_last("source"))
    s = s.withColumns(
        {
            "capped": F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most,
            "open": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
            "total": F.sum("source_size").over(Window.partitionBy()),
        }
    )
    level = (F.col("total") * F.lit(share) - F.col("capped")) / F.col("open")
    # to hold too few or too many sources at their limit lowers the level, so the right one is the highest
    s = s.withColumn("level", F.max(level).over(Window.partitionBy()))
    target = F.least(F.col("source_size").cast("double") * most, F.col("level") * F.col("weight"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, rows_per_range: int = 20_000) -> DataFrame:
    """doc_id, text_key, source, size, source_size, target, passes, taken per document row. text_key tells apart rows of one doc_id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("digest")
    sized = cut(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "source", n_words(F.col("text")).alias("size"), digest), "mix-sizes")
    n = sized.count()
    if not n:
        return sized.select("doc_id", "text_key", "source", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).alias("passes"), F.lit(0).cast("long").alias("taken"))
    digits = 1
    while 16**digits * rows_per_range < n:
        digits += 1
    targets = cut(source_targets(sized, weights, share, most), "mix-targets")
    ranges = sized.withColumn("part", F.substring("digest", 1, digits))
    sums = ranges.groupBy("source", "part").agg(F.sum("size").alias("words"))
    before = sums.select("source", "part", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    before = before.join(targets, before.source.eqNullSafe(targets.source)).select(before.source.alias("b_source"), F.col("part").alias("b_part"), "before", "source_size", "target")
    inside = F.sum("size").over(Window.partitionBy("source", "part").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    run = ranges.withColumn("inside", inside).join(before, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("part") == F.col("b_part")))
    run = run.withColumn("run", F.col("before") + F.col("inside")).drop("b_source", "b_part", "part", "before", "inside")
    run = cut(run, "mix-run")
    finish = lambda e: (F.col("run") + F.lit(e) * F.col("source_size")) / F.when(F.col("target") > 0, F.col("target"))
    key = lambda e: F.struct(finish(e).alias("finish"), F.col("digest"), F.lit(e).alias("pass"), F.coalesce("doc_id", F.lit(-1)).alias("doc"), F.col("size"))
    passes = range(most)
    entries = run.select(F.explode(F.array(*map(key, passes))).alias("entry")).where("entry.finish is not null")
    budget = targets.agg(F.sum("source_size")).first()[0] * share
    # the range of finish times that goes beyond the budget: whole numbers first, then by digits of 12 bits, which doubles hold exactly
    spots = lambda f, digits: F.floor(f * float(4096**digits))
    digits, over, spent = 0, None, 0
    while True:
        within = entries if over is None else entries.where(spots(F.col("entry.finish"), digits - 1) == over)
        found = within.groupBy(spots(F.col("entry.finish"), digits).alias("spot")).agg(F.sum("entry.size").alias("words"), F.count("*").alias("n"))
        upto = found.withColumn("upto", F.sum("words").over(Window.orderBy("spot").rowsBetween(Window.unboundedPreceding, 0)))  # 4,096 rows and, for whole numbers, few
        row = upto.where(F.col("upto") + spent > budget).orderBy("spot").limit(1).first()
        if row is None:
            break
        over, spent, digits = row.spot, spent + row.upto - row.words, digits + 1
        if row.n <= rows_per_range or digits == 5:
            break
    if over is None:
        taken = F.when(F.col("target") > 0, F.lit(most)).otherwise(0)
    else:
        near = entries.where(spots(F.col("entry.finish"), digits - 1) == over)
        running = F.sum("entry.size").over(Window.orderBy("entry").rowsBetween(Window.unboundedPreceding, 0)) + spent
        last = near.withColumn("running", running).where(F.col("running") <= budget).agg(F.max("entry").alias("e")).first().e
        if last is None:
            inside_cut = lambda e: spots(finish(e), digits - 1) < over
        else:
            edge = F.struct(F.lit(last.finish).alias("finish"), F.lit(last.digest).alias("digest"), F.lit(last["pass"]).alias("pass"), F.lit(last.doc).alias("doc"), F.lit(last.size).cast("long").alias("size"))
            inside_cut = lambda e: F.col("target").isNotNull() & finish(e).isNotNull() & (key(e) <= edge)
        taken = sum((F.when(inside_cut(e), 1).otherwise(0) for e in passes), F.lit(0))
    return run.select("doc_id", "text_key", "source", "size", "source_size", "target", taken.alias("passes")).withColumn("taken", (F.col("size") * F.col("passes")).cast("long"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each row as often as the mix takes it; columns as in docs, which must be orderable.

    Rows equal in id, text and source share their passes: p passes of k rows are p // k each, and one more for the first p % k in the order of the other columns.
    """
    m = mix(docs, **options).select(F.col("doc_id").alias("m_id"), F.col("text_key").alias("m_key"), F.col("source").alias("m_source"), "passes").groupBy("m_id", "m_key", "m_source").agg(F.sum("passes").alias("m_passes"), F.count("*").alias("m_rows")).where("m_passes > 0")
    d = docs.withColumn("m_text", F.xxhash64("text"))
    out = d.join(m, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("m_text") == F.col("m_key")) & F.col("source").eqNullSafe(F.col("m_source")))
    alone = out.where("m_rows = 1").withColumn("m_times", F.col("m_passes"))
    rest = [c for c in docs.columns if c != "text"]
    nth = F.row_number().over(Window.partitionBy("m_id", "m_key", "m_source").orderBy(*rest))
    equal = out.where("m_rows > 1").withColumn("m_times", F.floor(F.col("m_passes") / F.col("m_rows")) + F.when(nth <= F.col("m_passes") % F.col("m_rows"), 1).otherwise(0))
    both = alone.unionByName(equal)
    return both.withColumn("m_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("m_times") > 0, F.col("m_times").cast("int"))))).select(*docs.columns)
