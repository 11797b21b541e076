"""Writing tables, reports and metadata."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import attach
from ..operators.features import feature_registry
from ..operators.layout import plain


def write_table(df: DataFrame, path: str, by: list[str] = ["series_id"]) -> None:
    """Parquet, clustered by series and date: as many files as there are tasks, whatever the
    number of series, and a reader of one series skips the others by their statistics."""
    df = plain(df)
    order = [*by, "date"] if "date" in df.columns else by
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


# --- committed tables -------------------------------------------------------

def _hadoop(spark: SparkSession, path: str):
    """File system of a path, and the class of its paths."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark._jsc.hadoopConfiguration()), kind


def commit_table(df: DataFrame, path: str, by: list[str] = ["series_id"]) -> str:
    """Write a new version of the table at ``path`` and switch to it; the version's name.

    Files go to a folder of their own, then their manifest (rows, least and
    greatest values of the clustering columns per file), at last the name of the
    version replaces that in ``current`` by a rename. A writer that is lost
    leaves the old version in place, one that runs again writes another folder,
    and a finished commit removes all folders but its own.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    write_table(df, f"{path}/{version}", by)
    order = [c for c in [*by, "date"] if c in df.columns]
    made = spark.read.parquet(f"{path}/{version}").groupBy(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file")).agg(
        F.count(F.lit(1)).alias("n_rows"), *[f(c).alias(f"{n}_{c}") for c in order for n, f in (("least", F.min), ("most", F.max))]
    )
    made.write.parquet(f"{path}/{version}/_manifest")
    store, kind = _hadoop(spark, path)
    new = kind(f"{path}/next-{version}")
    out = store.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    replace = spark.sparkContext._gateway.new_array(options, 1)
    replace[0] = options.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(kind(path).toUri(), spark._jsc.hadoopConfiguration()).rename(new, kind(f"{path}/current"), replace)
    for status in store.listStatus(kind(path)):
        name = status.getPath().getName()
        if name.startswith(("v-", "next-")) and name != version:
            store.delete(status.getPath(), True)
    return version


def versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of versions that exist at ``path``."""
    store, kind = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(kind(path)) if s.getPath().getName().startswith("v-"))


def read_committed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The current version of a committed table, and its manifest; fails if a file has not the rows of the manifest."""
    version = spark.read.text(f"{path}/current").first()[0]
    table, manifest = spark.read.parquet(f"{path}/{version}"), spark.read.parquet(f"{path}/{version}/_manifest")
    own = table.groupBy(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file")).agg(F.count(F.lit(1)).alias("_n"))
    if not manifest.join(own, "file", "full").filter(~F.col("n_rows").eqNullSafe(F.col("_n"))).isEmpty():
        raise ValueError(f"{path}: files of version {version} are not those of its manifest")
    return table, manifest


def write_report_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def extend_report(report: DataFrame, section: str, part: DataFrame, keys: list[str] = ["series_id"]) -> DataFrame:
    """Report rows with one more section: the row of ``part`` with the same keys, as a struct."""
    rest = [c for c in part.columns if c not in keys]
    return report.drop(section).join(part.select(*keys, F.struct(*rest).alias(section)), keys, "left")


def row_hash(df: DataFrame) -> Column:
    """MD5 of the cells that are not NULL, by the order of column names; numbers with fractions count to six digits."""
    kinds = dict(df.dtypes)
    cell = lambda c: F.col(c).cast("decimal(38,6)") if kinds[c] in ("double", "float") or kinds[c].startswith("decimal") else F.col(c)
    return F.md5(F.concat_ws("|", *[F.concat(F.lit(f"{c}="), cell(c).cast("string")) for c in sorted(df.columns)]))


def dataset_metadata(df: DataFrame, source: str, keys: list[str] = ["series_id"]) -> DataFrame:
    """Dates, rows, missing cells and a content fingerprint per series.

    The fingerprint is the count of rows and the sums, modulo 2 ** 64, of both
    halves of a row hash. Sums can be merged, so it depends neither on the order
    of rows nor on the partitioning, and any engine with MD5 gives the same one.
    """
    df = plain(df)
    cells = [c for c in df.columns if c not in keys]
    missing = sum((F.count_if(F.col(c).isNull()) for c in cells[1:]), F.count_if(F.col(cells[0]).isNull()))
    half = lambda at: F.conv(F.substring(row_hash(df), at, 16), 16, 10).cast("decimal(20,0)")
    total = lambda at: (F.sum(half(at)) % F.lit(str(2**64)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string")
    return df.groupBy(*keys).agg(
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.count(F.lit(1)).alias("row_count"),
        missing.alias("missing_value_count"),
        F.lit(source).alias("source"),
        F.concat_ws("-", F.count(F.lit(1)).cast("string"), total(1), total(17)).alias("fingerprint"),
    )


def feature_metadata(df: DataFrame, selected: list[str], dropped: list[str]) -> DataFrame:
    """Selected and dropped features by group, with the rows and dates they cover."""
    spark = df.sparkSession
    status = spark.createDataFrame(
        [(f, "selected") for f in selected] + [(f, "dropped") for f in dropped],
        "feature string, status string",
    )
    groups = status.join(feature_registry(spark).drop("halo"), "feature", "left").fillna("unknown", subset=["feature_group"])
    info = df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
    )
    by_group = groups.groupBy("feature_group", "status").agg(
        F.sort_array(F.collect_list("feature")).alias("features"), F.count(F.lit(1)).alias("feature_count")
    )
    return attach(by_group, info)
