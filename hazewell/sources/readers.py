"""Readers, writers and inventory of parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazewell.schemas import REQUIRED

# Columns expected of each known data set.
KNOWN_SCHEMAS = {
    "locations": ["id", "name", "country", "coordinates", "sensors", "isMobile"],
    "measurements": ["value", "unit", "datetime", "coordinates", "quality"],
    "sensors": ["id", "name", "parameter"],
}


def require(df: DataFrame, kind: str) -> DataFrame:
    """The same table, or an error naming the required columns it lacks."""
    missing = [c for c in REQUIRED[kind] if c not in df.columns]
    if missing:
        raise ValueError(f"{kind}: missing required columns {missing}")
    return df


def read_table(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return require(reader.parquet(path), kind)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one where the path does not exist."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_partitioned(df: DataFrame, path: str) -> None:
    """Write by station, year and month; the rebalance splits a station-month too big for one task."""
    parts = df.withColumns({"year": F.year("datetime_utc"), "month": F.month("datetime_utc")})
    keys = ["station_id", "year", "month"]
    parts.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).option("compression", "snappy").parquet(path)


def pm25_readings(raw: DataFrame) -> DataFrame:
    """Long measurements to the wide contract: keep one parameter and name its value."""
    return raw.filter(F.col("parameter") == "pm25").drop("parameter").withColumnRenamed("value", "pm25")


def combine_targets(parts: DataFrame) -> DataFrame:
    """One hourly table from all partitions: incomplete rows dropped, one row per station, hour and parameter, files sorted."""
    from hazewell.operators.clean import dedupe, drop_incomplete

    done = dedupe(drop_incomplete(parts), ["station_id", "datetime_utc", "parameter"], ["event_id"])
    return done.sortWithinPartitions("station_id", "datetime_utc")


def targets_quality(parts: DataFrame, keys: Sequence[str] = ("station_id", "year", "month")) -> DataFrame:
    """Record counts and quality score of every partition that ``combine_targets`` takes in; without keys, of all together."""
    from hazewell.operators.quality import quality_score, record_quality

    return quality_score(record_quality(parts, keys=keys))


def write_compact(df: DataFrame, path: str, keep: Sequence[str] = ()) -> None:
    """Narrow types (float, int) with dictionary encoding."""
    narrow = {T.DoubleType: "float", T.LongType: "int"}
    cols = [
        F.col(f.name).cast(narrow[type(f.dataType)]).alias(f.name) if type(f.dataType) in narrow and f.name not in keep else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*cols).write.mode("overwrite").option("parquet.enable.dictionary", "true").parquet(path)


def file_name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def file_footers(spark: SparkSession, paths: list[str], glob: str = "*.parquet") -> DataFrame:
    """One row per file below the paths: path, table (the named path it belongs to), length, modified, and from its footer readable, n_rows and columns.

    Files are listed by Spark; footers, never contents, are read in the tasks. A damaged file is a row that is not readable.
    """
    listed = None
    for path in paths:
        one = _files(spark, path, glob).select("path", F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("table"), "length", F.col("modificationTime").alias("modified"))
        listed = one if listed is None else listed.unionByName(one)

    def look(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            found = []
            for path in batch["path"]:
                try:
                    store, name = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
                    with store.open_input_file(name) as f:
                        footer = pq.ParquetFile(f)
                        found.append((True, footer.metadata.num_rows, footer.schema_arrow.names))
                except Exception:  # any damage: that is what the check is for
                    found.append((False, None, []))
            batch["readable"], batch["n_rows"], batch["columns"] = zip(*found) if found else ((), (), ())
            batch["n_rows"] = batch["n_rows"].astype("Int64")
            yield batch

    return listed.mapInPandas(look, "path string, table string, length long, modified timestamp, readable boolean, n_rows long, columns array<string>")


def validate_dataset(spark: SparkSession, paths: list[str], expected: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per file: rows, and whether it can be read, holds rows and has the columns its table must have."""
    files = file_footers(spark, paths)
    whole = F.lit(True)
    for table, columns in (expected or {}).items():
        whole &= (F.col("table") != table) | (F.size(F.array_except(F.array(*map(F.lit, columns)), "columns")) == 0)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "table", "n_rows", (F.col("readable") & (F.coalesce("n_rows", F.lit(0)) > 0) & whole).alias("valid"))


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """One row per parquet file below a folder: path, bytes, time of change, rows and the known data set that its columns fit."""
    files = file_footers(spark, [root])
    sets = match_schema(files, "columns").groupBy("path").agg(F.min_by("dataset", F.struct(-F.col("share"), "dataset")).alias("dataset"))
    return files.join(sets, "path", "left").select("path", "length", "modified", "readable", "n_rows", "dataset")


def _files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)


def scan_inventory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files below a folder with totals per extension and folder; contents are not read."""
    files = _files(spark, root, glob).select(
        F.regexp_extract("path", r"\.([^./]+)$", 1).alias("extension"),
        F.regexp_replace("path", r"/[^/]*$", "").alias("folder"),
        F.col("length"),
        F.col("modificationTime"),
    )
    totals = files.groupingSets([["extension"], ["folder"], []], "extension", "folder").agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest")
    )
    return totals


def file_hash(spark: SparkSession, root: str, glob: str = "*.parquet", chunk: int = 8 << 20) -> DataFrame:
    """SHA-256 of each file, read in parts of bounded size: no file is ever one value."""
    def digest(batches):
        import hashlib

        from pyarrow import fs

        for batch in batches:
            sums = []
            for path in batch["path"]:
                store, name = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
                h = hashlib.sha256()
                with store.open_input_stream(name) as f:
                    while data := f.read(chunk):
                        h.update(data)
                sums.append(h.hexdigest())
            batch["sha256"] = sums
            yield batch[["file", "length", "sha256"]]

    files = _files(spark, root, glob).select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    return files.mapInPandas(digest, "file string, length long, sha256 string")


def match_schema(df: DataFrame, cols: str, least: float = 0.8) -> DataFrame:
    """Known data sets whose expected columns are found to at least the given share."""
    out = df.withColumn("m", F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("dataset"),
            (F.size(F.array_intersect(F.col(cols), F.array(*map(F.lit, exp)))) / len(exp)).alias("share"),
        )
        for name, exp in KNOWN_SCHEMAS.items()
    ])))
    return out.filter(F.col("m.share") >= least).select(*df.columns, "m.dataset", "m.share")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the greatest by the order columns: a partial aggregate, safe for any number of copies."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, "_b.*").select(*df.columns)


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """File names below a folder; contents are not read."""
    return _files(spark, root, glob).select(F.element_at(F.split("path", "/"), -1).alias("file"))
