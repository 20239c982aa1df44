"""Listings cut into fixed-size shards, one page per shard."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from larkspur.operators.listings import clamp_size, filter_country, slice_window
from larkspur.operators.numbering import dealt_positions
from larkspur.session import stored
from larkspur.sources.listings import path_exists

DEFAULT_COUNTRY = "US"
#: Shards in one file.
FILE_SHARDS = 200
#: Builds of a source and country that stay readable, and folders that one build's files lie in at most.
KEEP_BUILDS = 2
MOST_FOLDERS = 20


def source_hash(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 24)


def shard_keys(url: Column, country: Column, shard_index: Column) -> tuple[Column, Column]:
    """Names of the meta entry and of one shard entry."""
    parts = [source_hash(url), F.upper(country)]
    return (
        F.concat_ws(":", F.lit("meta"), *parts),
        F.concat_ws(":", F.lit("shard"), *parts, shard_index.cast("string")),
    )


def with_shard(df: DataFrame, country: str | None, rows_per_shard: int | None = None) -> DataFrame:
    """Rows of the country with ``shard_index``, in input order; those of one file lie in two tasks at most."""
    size = clamp_size(rows_per_shard)
    numbered = dealt_positions(filter_country(df, country_code(country)), "ordinal", size * FILE_SHARDS)
    return numbered.withColumn("shard_index", F.floor(F.col("position") / size).cast("long")).drop("position")


def country_code(country: str | None) -> str:
    return (country or "").strip().upper() or DEFAULT_COUNTRY


FILES = "_file int, folder string, content string, rows bigint"


def file_contents(rows: DataFrame) -> DataFrame:
    """(_file, content, rows): a digest of each file's rows, whatever their order, from one partly pre-aggregated sum."""
    columns = sorted(c for c in rows.columns if c != "_file")
    # A null leaves a hash as it is, hence the flags.
    values = [*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns]]
    summed = rows.groupBy("_file").agg(
        F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*values)).alias("_x"),
        F.sum(F.xxhash64(F.lit(1), *values).cast("decimal(38,0)")).alias("_s"),
    )
    kinds = ",".join(f"{c} {t}" for c, t in sorted(rows.dtypes))
    content = F.sha2(F.concat_ws(":", F.lit(kinds), "rows", "_x", "_s"), 256)
    return summed.select("_file", content.alias("content"), "rows")


def build_shards(
    spark: SparkSession, df: DataFrame, path: str, url: str, built_at: str,
    country: str | None = None, rows_per_shard: int | None = None,
) -> DataFrame:
    """Write the shards of one source and country that have changed, then the meta row that makes the build visible.

    Builds of many sources and countries share ``path``. Shards lie in files of FILE_SHARDS each. A build's list of files names
    the folder of each and a digest of its rows. The rows are shuffled once and written to a folder of the build's own, and the
    digests are taken from there: files whose digest is that of the live build are taken over, and their copies in the new
    folder are deleted before the build is visible. Shard numbers are dense, so that rows are dealt to files without
    sampling. Files that the last KEEP_BUILDS builds don't name are deleted.
    """
    size, code = clamp_size(rows_per_shard), country_code(country)
    build = f"b{uuid.uuid4().hex}"
    numbered = with_shard(df, code, size)
    rows = numbered.withColumn("_file", F.floor(F.col("shard_index") / FILE_SHARDS).cast("int"))
    meta = shard_meta(spark, path, url, code)
    live = meta.first() if meta is not None else None
    if live is not None and live["rows_per_shard"] == size:
        before = build_files(spark, path, live["build"])
        if before.select("folder").distinct().count() > MOST_FOLDERS:
            before = before.limit(0)  # written anew, so that a build never spreads over ever more folders
    else:
        before = spark.createDataFrame([], FILES)
    old = before.select("_file", F.col("folder").alias("_folder"), F.col("content").alias("_content"))
    same = F.coalesce(F.col("content") == F.col("_content"), F.lit(False))
    rows.sortWithinPartitions("_file", "shard_index", "ordinal").write.partitionBy("_file").parquet(f"{path}/shards/{build}")
    written = _held(spark, path, build, numbered.schema)
    files = stored(
        file_contents(written).join(old, "_file", "left").select(
            "_file", F.when(same, F.col("_folder")).otherwise(F.lit(build)).alias("folder"), "content", "rows"
        ),
        "files",
    )
    fs, at = _file_system(spark, path)
    for r in files.where(F.col("folder") != build).select("_file").toLocalIterator():
        fs.delete(at(f"shards/{build}/_file={r['_file']}"), True)
    files.write.parquet(f"{path}/files/{build}")
    total = F.col("total_filtered_rows")
    made = files.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total_filtered_rows")).select(
        F.lit(url).alias("csv_url"),
        source_hash(F.lit(url)).alias("source_hash"),
        F.lit(code).alias("country_code"),
        F.lit(size).cast("long").alias("rows_per_shard"),
        total,
        F.ceil(total / size).cast("long").alias("shard_count"),
        F.lit(built_at).alias("built_at"),
        F.lit(build).alias("build"),
        F.unix_micros(F.current_timestamp()).alias("written"),
        F.lit(json.dumps(numbered.schema.jsonValue())).alias("columns"),
    )
    made.coalesce(1).write.parquet(f"{path}/meta/of={build}")
    drop_old_builds(spark, path, url, code)
    return shard_meta(spark, path, url, code)


def _builds(spark: SparkSession, path: str, url: str, country: str | None) -> DataFrame:
    """The meta rows of one source and country, the newest first."""
    own = spark.read.parquet(f"{path}/meta").drop("of").where(
        (F.col("source_hash") == source_hash(F.lit(url))) & (F.col("country_code") == country_code(country))
    )
    return own.orderBy(F.col("written").desc(), "build")


def _held(spark: SparkSession, path: str, folder: str, schema: StructType) -> DataFrame:
    """All rows under a folder of shards, with their ``_file``."""
    return spark.read.schema(StructType([*schema.fields, StructField("_file", IntegerType())])).parquet(f"{path}/shards/{folder}")


def build_files(spark: SparkSession, path: str, build: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(f"{path}/files/{build}")


def drop_old_builds(spark: SparkSession, path: str, url: str, country: str | None = None) -> int:
    """Delete builds of one source and country but the last KEEP_BUILDS, and files that none of these names; how many files."""
    fs, at = _file_system(spark, path)
    builds = [r["build"] for r in _builds(spark, path, url, country).select("build").collect()]
    kept, old = builds[:KEEP_BUILDS], builds[KEEP_BUILDS:]
    if not old:
        return 0
    named = spark.read.schema(FILES).parquet(*[f"{path}/files/{b}" for b in kept]).select("folder", "_file")
    past = spark.read.schema(FILES).parquet(*[f"{path}/files/{b}" for b in old]).select("folder", "_file").distinct()
    dropped = 0
    for r in past.join(named, ["folder", "_file"], "left_anti").toLocalIterator():
        dropped += fs.delete(at(f"shards/{r['folder']}/_file={r['_file']}"), True)
    # Folders of which nothing is named any more; MOST_FOLDERS bounds those of one build.
    for r in past.select("folder").distinct().join(named.select("folder").distinct(), "folder", "left_anti").collect():
        fs.delete(at(f"shards/{r['folder']}"), True)
    for build in old:
        fs.delete(at(f"meta/of={build}"), True)
        fs.delete(at(f"files/{build}"), True)
    return dropped


def _file_system(spark: SparkSession, path: str):
    """The file system of a path, and a function that makes its paths."""
    jvm = spark.sparkContext._jvm
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    return at("meta").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shard_meta(spark: SparkSession, path: str, url: str, country: str | None = None) -> DataFrame | None:
    """The row of the newest build of one source and country; None if there is none."""
    newest = _newest(spark, path, url, country)
    return None if newest is None else newest.drop("columns")


def _newest(spark: SparkSession, path: str, url: str, country: str | None) -> DataFrame | None:
    if not path_exists(spark, f"{path}/meta"):
        return None
    newest = _builds(spark, path, url, country).limit(1)
    return None if newest.isEmpty() else newest.drop("written")


def read_shards(spark: SparkSession, path: str, url: str, country: str | None = None, file: int | None = None) -> DataFrame:
    """All rows of the live build of a source and country with their ``shard_index``, or those of one file."""
    newest = _newest(spark, path, url, country)
    if newest is None:
        raise FileNotFoundError(f"no shards of {url} for {country_code(country)} under {path}")
    live = newest.first()
    schema = StructType.fromJson(json.loads(live["columns"]))
    files = build_files(spark, path, live["build"])
    files = files if file is None else files.where(F.col("_file") == file)
    found = spark.createDataFrame([], schema)
    for n, r in enumerate(files.select("folder").distinct().collect()):  # at most MOST_FOLDERS
        held = _held(spark, path, r["folder"], schema)
        if file is None:
            own = files.where(F.col("folder") == r["folder"]).select("_file")
            held = held.join(own, "_file", "left_semi")
        else:
            held = held.where(F.col("_file") == file)
        held = held.select(*found.columns)
        found = found.unionByName(held) if n else held
    return found


def read_page(
    spark: SparkSession, path: str, url: str, page: int | None, live: DataFrame | None = None,
    country: str | None = None, per_page: int | None = None,
) -> DataFrame:
    """Rows of one page of a source and country. Past the last shard it is empty; without a build the live listings are
    sliced."""
    number = max(1, int(page or 1))
    if shard_meta(spark, path, url, country) is None:
        if live is None:
            raise FileNotFoundError(f"no shards of {url} for {country_code(country)} under {path}")
        size = clamp_size(per_page)
        return slice_window(live, country_code(country), (number - 1) * size, size)
    file = (number - 1) // FILE_SHARDS
    return read_shards(spark, path, url, country, file).where(F.col("shard_index") == number - 1).orderBy("ordinal")


def shard_pagination(
    spark: SparkSession, path: str, url: str, page: int | None, per_page: int | None = None, country: str | None = None
) -> DataFrame:
    """One row describing a page of the shards of a source and country."""
    number = max(1, int(page or 1))
    wanted = clamp_size(per_page)
    size, count = F.col("rows_per_shard"), F.col("shard_count")
    meta = shard_meta(spark, path, url, country)
    if meta is None:
        raise FileNotFoundError(f"no shards of {url} for {country_code(country)} under {path}")
    return meta.select(
        F.lit(number).cast("long").alias("page"),
        size.alias("per_page"),
        F.lit(wanted).cast("long").alias("requested_per_page"),
        (size == wanted).alias("per_page_matches_shard"),
        ((number - 1) * size).alias("offset"),
        F.col("total_filtered_rows"),
        count.alias("total_pages"),
        F.lit(number > 1).alias("has_prev"),
        (F.lit(number) < count).alias("has_next"),
        F.when(F.lit(number) <= count, F.lit(number - 1)).cast("long").alias("shard_index"),
    )
