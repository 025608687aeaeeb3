"""Sources and sinks: nested archives of pipe-delimited records, vintages, manifests, views, artefacts, cells."""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

VINTAGE = re.compile(r"(\d{4}Q[1-4])")


def text_schema(columns: Sequence[str]) -> StructType:
    """Records are text until they are cleaned: sentinels and letters would break casts."""
    return StructType([StructField(c, StringType()) for c in columns])


def read_delimited(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """Headerless pipe-delimited files; columns that are not kept are not parsed."""
    d = spark.read.schema(text_schema(columns)).option("sep", "|").option("emptyValue", None).csv(paths)
    return d.select(*keep) if keep else d


def _members(content: bytes, kind: str) -> Iterator[tuple[str, io.BufferedIOBase]]:
    """Text members whose name begins with kind, through any depth of archives."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in z.namelist():
            if name.lower().endswith(".zip"):
                yield from _members(z.read(name), kind)
            elif name.rsplit("/", 1)[-1].startswith(kind):
                yield name, z.open(name)


def read_archives(spark: SparkSession, paths: str, columns: Sequence[str], kind: str, keep: Sequence[str] | None = None, lines_at_once: int = 50_000) -> DataFrame:
    """Archives within archives, a task each, streamed line by line; with the vintage of the member's name."""
    keep = list(keep or columns)
    at = [columns.index(c) for c in keep]
    schema = StructType([*text_schema(keep).fields, StructField("vintage", StringType())])

    def rows(batches):
        import pandas as pd

        for files in batches:
            for content in files["content"]:
                for name, stream in _members(bytes(content), kind):
                    tag = VINTAGE.search(name)
                    block: list[list] = []
                    for line in io.TextIOWrapper(stream, "utf-8", newline="\n"):
                        cells = line.rstrip("\r\n").split("|")
                        block.append([(cells[k] or None) if k < len(cells) else None for k in at] + [tag[1] if tag else None])
                        if len(block) == lines_at_once:
                            yield pd.DataFrame(block, columns=[f.name for f in schema])
                            block = []
                    if block:
                        yield pd.DataFrame(block, columns=[f.name for f in schema])

    return spark.read.format("binaryFile").load(paths).select("content").mapInPandas(rows, schema)


def ingest(records: DataFrame, path: str) -> None:
    """Writes records by vintage; vintages that are there and in records are replaced, others stay."""
    records.write.partitionBy("vintage").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows per vintage of what was ingested, from the files' own counts."""
    return spark.read.parquet(path).groupBy(F.col("vintage").cast("string").alias("vintage")).agg(F.count("*").alias("rows"))


def audit(ingested: DataFrame, expected: DataFrame) -> DataFrame:
    """Vintages with both counts and whether they agree; only then may archives go."""
    e = expected.select("vintage", F.col("rows").alias("expected"))
    return ingested.join(e, "vintage", "full").withColumn("safe_to_delete", F.coalesce(F.col("rows") == F.col("expected"), F.lit(False)))


def discover_years(names: Sequence[str]) -> list[int]:
    return sorted({int(m[0]) for n in names if (m := re.search(r"(?:19|20)\d{2}", n))})


def write_cells(cells: DataFrame, path: str) -> None:
    """Cells by vintage, with the observation month beside the key and sorted by it, so that windows of it skip row groups."""
    c = cells.withColumn("observation_month", F.col("origination_month") + F.col("age"))
    c.repartition("vintage").sortWithinPartitions("observation_month").write.partitionBy("vintage").mode("overwrite").parquet(path)


def read_cells(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Cells observed in a window of months; filter and columns reach the scan."""
    c = spark.read.parquet(path)
    if first is not None:
        c = c.where(F.col("observation_month") >= first)
    if last is not None:
        # a vintage later than the window's end holds nothing of it: whole partitions are left out
        c = c.where((F.col("observation_month") <= last) & (F.col("vintage").cast("string").substr(1, 4).cast("int") <= last // 12))
    return c.select(*columns) if columns else c


def write_view(view: DataFrame, path: str, description: dict, forbidden: Sequence[str] = ("loan_id", "loan", "loan_identifier")) -> dict:
    """A small published table with its description; columns that identify loans are refused."""
    if bad := set(view.columns) & set(forbidden):
        raise ValueError(f"a view must not hold {sorted(bad)}")
    view.coalesce(1).write.mode("overwrite").parquet(path)
    entry = {**description, "columns": view.columns, "fingerprint": fingerprint({**description, "columns": view.columns})}
    view.sparkSession.createDataFrame([(json.dumps(entry, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.description")
    return entry


def read_view(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(path), json.loads(spark.read.text(f"{path}.description").first().value)


def write_views(views: Mapping[str, DataFrame], path: str, descriptions: Mapping[str, dict]) -> list[dict]:
    """Views side by side, and a manifest of their names, columns and fingerprints, written last."""
    entries = [{"view": n, **write_view(v, f"{path}/{n}", descriptions.get(n, {}))} for n, v in views.items()]
    if entries:
        spark = next(iter(views.values())).sparkSession
        spark.createDataFrame([(json.dumps(e, sort_keys=True),) for e in entries], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return entries


def read_manifest(spark: SparkSession, path: str) -> list[dict]:
    return sorted((json.loads(r.value) for r in spark.read.text(f"{path}/manifest").collect()), key=lambda e: e["view"])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached_series(spark: SparkSession, path: str, name: str, fetch: Callable[[], DataFrame], first: int | None = None, last: int | None = None) -> DataFrame:
    """month, value of a series: from the cache, or fetch() once and keep it. Months outside first and last are left out; a series that begins after first, or has no month at all, is an error."""
    place = f"{path}/{name}"
    if not _exists(spark, f"{place}/_SUCCESS"):
        fetch().select(F.col("month").cast("int").alias("month"), F.col("value").cast("double").alias("value")).coalesce(1).write.mode("overwrite").parquet(place)
    series = spark.read.parquet(place)
    start = series.where("value is not null").agg(F.min("month")).first()[0]
    if start is None or (first is not None and start > first):
        raise ValueError(f"{name} begins in month {start}, {first} is asked for")
    if first is not None:
        series = series.where(F.col("month") >= first)
    return series.where(F.col("month") <= last) if last is not None else series


def fingerprint(description: dict) -> str:
    return hashlib.sha256(json.dumps(description, sort_keys=True, default=str).encode()).hexdigest()


def table_identity(spark: SparkSession, path: str) -> str:
    """A fingerprint of a table's files: names, sizes and times of writing. A table that was written anew has another one, even with as many rows."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, files = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True), []
    while found.hasNext():
        f = found.next()
        if not f.getPath().getName().startswith(("_", ".")):
            files.append(f"{f.getPath().toString()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(files)).encode()).hexdigest()


def save_fit(spark: SparkSession, path: str, fit, description: dict) -> str:
    """A fit as one JSON line under the fingerprint of its description; returns the fingerprint."""
    key = fingerprint(description)
    body = {"description": description, "family": fit.family, "names": fit.names, "params": fit.params.tolist(), "covariance": fit.covariance.tolist(), "log_likelihood": fit.log_likelihood, "rounds": fit.rounds, "events": fit.events, "exposure": fit.exposure}
    spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{key}")
    return key


def find_fits(spark: SparkSession, path: str, **wanted) -> list[dict]:
    """Descriptions and fingerprints of the kept fits that have all the wanted entries, best likelihood first."""
    if not _exists(spark, path):
        return []
    found = [json.loads(r.value) for r in spark.read.text(f"{path}/*").collect()]  # a line per fit
    rows = [{"fingerprint": fingerprint(b["description"]), **b["description"], "log_likelihood": b["log_likelihood"]} for b in found if all(b["description"].get(k) == v for k, v in wanted.items())]
    return sorted(rows, key=lambda r: -r["log_likelihood"])


def load_fit(spark: SparkSession, path: str, description: dict):
    """The fit of a description, or None."""
    import numpy as np

    from cohortica.operators.model import Fit

    if not _exists(spark, f"{path}/{fingerprint(description)}"):
        return None
    b = json.loads(spark.read.text(f"{path}/{fingerprint(description)}").first().value)
    return Fit(b["family"], b["names"], np.array(b["params"]), np.array(b["covariance"]), b["log_likelihood"], b["rounds"], b["events"], b["exposure"])


def warm_start(spark: SparkSession, path: str, description: dict):
    """Parameters by name of the best kept fit of the same family that shares most covariates, or None. Another table's fit may serve: a start changes no result, only the number of steps."""
    rows = find_fits(spark, path, family=description.get("family"))
    mine = set(description.get("covariates", ()))
    best = max(rows, key=lambda r: len(mine & set(r.get("covariates", ()))), default=None)
    if best is None:
        return None
    kept = load_fit(spark, path, {k: v for k, v in best.items() if k not in ("fingerprint", "log_likelihood")})
    return kept and dict(zip(kept.names, kept.params.tolist(), strict=True))


def fit_once(spark: SparkSession, path: str, description: dict, fit, warm: bool = False):
    """The cached fit of a description, or fit() and keep it. warm: fit is given the parameters of a kept fit like it, or None."""
    found = load_fit(spark, path, description)
    if found is None:
        found = fit(*([warm_start(spark, path, description)] if warm else []))
        save_fit(spark, path, found, description)
    return found


def markdown_table(rows: Sequence[dict]) -> str:
    if not rows:
        return ""
    names = list(rows[0])
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(names), line("---" for _ in names), *[line(r[n] for n in names) for r in rows]])
