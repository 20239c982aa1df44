"""Listing snapshots: CSV and JSON scans, and the choice between sources."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import text as tx
from larkspur.operators.listings import ALIASES
from larkspur.sources.order import input_order, with_ordinal


def read_listings_csv(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """All-text rows of a CSV snapshot with header.

    Cells are trimmed, blank rows dropped, short rows padded with '' and extra cells ignored. ``ordinal``
    grows with file name and line. A file with quoted line breaks cannot be split, so land a large snapshot
    once with ``land_listings_csv``, or pass ``multi_line=False`` where no cell holds a line break.
    """
    raw = spark.read.csv(path, header=True, multiLine=multi_line, quote='"', escape='"', inferSchema=False)
    names = [c.strip() for c in raw.columns]
    cells = [tx.trim(tx.blank_if_null(F.col(f"`{old}`"))).alias(new) for old, new in zip(raw.columns, names)]
    rows = raw.select(input_order().alias("_order"), *cells)
    filled = F.lit(False)
    for name in names:
        filled = filled | (F.col(f"`{name}`") != "")
    return with_ordinal(rows.where(filled), "_order").select("ordinal", *[f"`{n}`" for n in names])


def land_listings_csv(spark: SparkSession, path: str | list[str], target: str, multi_line: bool = True) -> DataFrame:
    """Store a CSV snapshot as Parquet with ``ordinal``, so that later reads are split, pruned and pushed down."""
    read_listings_csv(spark, path, multi_line).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


_ROW = T.MapType(T.StringType(), T.StringType())
_ROWS = T.ArrayType(_ROW)


def read_payloads(df: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Rows of JSON payloads shaped as an array, {"jobs": []} or {"data": []}; anything else gives none.

    The result keeps the other columns and adds ``place`` (position in the payload) and ``row``, a map.
    """
    payload = F.col(payload_col)

    def wrapped(field: str) -> Column:
        inner = F.get_json_object(payload, f"$.{field}")
        return F.when(inner.startswith("["), F.from_json(inner, _ROWS))

    is_list = F.ltrim(payload).startswith("[")
    rows = F.when(is_list, F.from_json(payload, _ROWS)).otherwise(F.coalesce(wrapped("jobs"), wrapped("data")))
    others = [c for c in df.columns if c != payload_col]
    return df.select(*others, F.posexplode(rows).alias("place", "row")).where(F.col("row").isNotNull())


def payload_listings(df: DataFrame, names: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """Columns from the maps of ``read_payloads``, under every name an alias may use."""
    fields = sorted({n for options in names.values() for n in options})
    others = [c for c in df.columns if c != "row"]
    return df.select(*others, *[F.col("row")[f].alias(f) for f in fields])


def read_listings_json(spark: SparkSession, path: str | list[str], whole_files: bool = False) -> DataFrame:
    """Listings of payloads, one per line, or one per file that may spread over lines.

    ``ordinal`` grows with file name, line and place in the payload; a payload holds fewer than 2**31 rows.
    """
    texts = spark.read.text(path, wholetext=whole_files).select(F.col("value").alias("payload"), input_order().alias("_order"))
    rows = payload_listings(read_payloads(with_ordinal(texts, "_order", "_text")))
    ordinal = F.shiftleft(F.col("_text"), 31) + F.col("place")
    return rows.withColumn("ordinal", ordinal).drop("_text", "place")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds anything under a path; nothing is read."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def first_available(spark: SparkSession, paths: list[str]) -> str:
    """The first path that exists: the remote snapshot, else the bundled ones."""
    for path in paths:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError("no listing source among " + ", ".join(paths))
