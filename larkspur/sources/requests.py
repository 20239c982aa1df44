"""Request records as JSON lines, as a table or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.operators.usage import ingest_requests

REQUEST_SCHEMA = (
    "request_id bigint, ts timestamp, url string, method string, user_agent string, sec_ch_ua_platform string, "
    "referer string, ip_address string, country string"
)


def read_requests(spark: SparkSession, path: str, stream: bool = False, files_per_batch: int = 1000) -> DataFrame:
    """Accepted request records under a folder."""
    if stream:
        reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    else:
        reader = spark.read
    return ingest_requests(reader.schema(REQUEST_SCHEMA).json(path))
