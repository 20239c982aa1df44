"""Results do not depend on the session time zone."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = (
    "n7_freshness", "n8_job_card", "a7_usage_by_date", "a10_vote_state_with_authors", "a15_skill_trend", "f8_check_updates",
    "m1_usage_stream", "m3_member_stream", "f7_retention", "a13_job_state",
)


@pytest.mark.parametrize("name", NAMES)
def test_other_zone(spark, name):
    spark.conf.set("spark.sql.session.timeZone", "America/St_Johns")
    try:
        assert compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
