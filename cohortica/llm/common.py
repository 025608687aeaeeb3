"""What the operators share: shared-folder tables, row identities, connected components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortica.sources.shared import shared_dir

#: The words of every operator: runs of anything but ASCII white space. bytes.split() cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = "\t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Folders of the tables that cut() wrote, by application, oldest first.
WRITTEN: dict[str, list[str]] = {}


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: lineage ends here, and a lost executor costs no recomputation. release() removes what is not needed any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, keep: int = 0, start: int = 0) -> None:
    """Remove the tables that cut() wrote in this session since `start`, but for the last `keep`. Only for callers that know that no frame reads them: results must have been written elsewhere."""
    paths = WRITTEN.get(spark.sparkContext.applicationId, [])
    gone = paths[start : len(paths) - keep]
    for p in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    paths[start : len(paths) - keep] = []


def written(spark: SparkSession) -> int:
    """How many tables there are: the start of those that follow."""
    return len(WRITTEN.get(spark.sparkContext.applicationId, []))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone, as bytes.lower() does."""
    return F.translate(c, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words of a text (null: 0), inside the JVM: blanks become one blank, and the blanks between words are counted."""
    squeezed = F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")
    trimmed = F.trim(squeezed)
    blanks = F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit("")))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.lit(0)).otherwise(blanks + 1).cast("long")


def parts(spark: SparkSession, total: float, each: float, least: int = 1) -> int:
    """Number of shards of a given size that a total needs; grows with the data, never capped."""
    return max(least, int(-(-max(total, 1) // each)))


#: Edges up to which components are found in one task (two numbers each: some megabytes).
FEW_EDGES = 250_000


def smallest_reachable(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the nodes 0..n-1 that each can reach by edges x - y."""
    group = np.arange(n)
    while True:
        low = np.minimum(group[x], group[y])
        new = group.copy()
        np.minimum.at(new, group[x], low)
        np.minimum.at(new, group[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == group).all():
            return group
        group = new


def _in_one_task(batches):
    ends = [np.concatenate([np.zeros(0, np.int64), *z]) for z in zip(*((b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches), strict=True)]
    if ends:
        ids, at = np.unique(np.concatenate(ends), return_inverse=True)
        found = smallest_reachable(at[: len(ends[0])], at[len(ends[0]) :], len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[found])], names=["id", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", label: str = "cc", few: int = FEW_EDGES) -> DataFrame:
    """Connected components of an edge list: (id, component) for every id on an edge, component the smallest id reachable.

    Up to `few` edges, which are counted first, one task finds them. Beyond that: alternating large-star and small-star steps (Kiveris et al., 2014), each a minimum per node, which combines before the shuffle, and
    one equi-join whose other side has one row per node, so that a hub is split by adaptive skew handling. Every round is written to the
    shared folder, and the round before it removed. Null ends and loops are ignored; an empty input gives an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    spark, start = edges.sparkSession, written(edges.sparkSession)
    e = cut(e, label)
    if e.count() <= few:
        return e.repartition(1).mapInArrow(_in_one_task, "id long, component long")
    seen = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour of u moves to the smallest node around u
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = e.where("u <> v").distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").select("u", "v", "m")
        e = e.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(e.select("u", F.col("m").alias("v")))
        e = cut(e.where("u <> v").distinct(), label)
        release(spark, 1, start)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.count(F.when(F.col("u") < F.col("v"), 1))).first()
        if now == seen:
            break
        if not now[0]:
            break
        seen = now
    stars = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    hubs = stars.select(F.col("component").alias("id")).distinct().withColumn("component", F.col("id"))
    return stars.unionByName(hubs)


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once per row. A plain column could be put back into the expressions that use it, and so be evaluated again for every element of an array function; a generator is not."""
    return df.select("*", F.explode(F.array(value)).alias(name))
