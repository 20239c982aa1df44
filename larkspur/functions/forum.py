"""Forum text, keys and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.text import SPACE_CHARS, blank_if_null, trim

# Longest title, body and comment.
TITLE_MAX, BODY_MAX, COMMENT_MAX = 300, 6000, 4000


def clean_forum_text(c: Column, most: int = 2000) -> Column:
    """Drop white space before line ends and blank lines, shrink runs of blanks, trim and cut."""
    lines = F.split(blank_if_null(c), "\n")
    stripped = F.transform(lines, lambda line: F.rtrim(line, F.lit(SPACE_CHARS)))
    text = F.array_join(F.filter(stripped, lambda line: line != ""), "\n")
    return F.substring(trim(F.regexp_replace(text, r"[ \t]{2,}", " ")), 1, most)


def vote_key(kind: Column, company_slug: Column, post_id: Column, comment_id: Column) -> Column:
    parts = [blank_if_null(c.cast("string")) for c in (kind, company_slug, post_id, comment_id)]
    return F.concat_ws(":", *parts)


def vote_id(kind: Column, target_id: Column, user_uid: Column) -> Column:
    joined = F.concat_ws("_", *[blank_if_null(c.cast("string")) for c in (kind, target_id, user_uid)])
    return F.substring(F.regexp_replace(joined, "[^A-Za-z0-9_-]", "_"), 1, 240)


def time_millis(number: Column, text_millis: Column, now_ms: int) -> Column:
    """A time given as a number or as parsed text; 0, NULL and unreadable text mean now."""
    return F.coalesce(F.nullif(number, F.lit(0)), text_millis, F.lit(now_ms)).cast("long")


def age_label(created_ms: Column, now_ms: int) -> Column:
    minutes = F.floor(F.greatest(F.lit(0).cast("long"), F.lit(now_ms) - created_ms) / 60000).cast("long")
    hours = F.floor(minutes / 60).cast("long")
    days = F.floor(hours / 24).cast("long")
    return (
        F.when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago")))
        .when(hours < 48, F.concat(hours.cast("string"), F.lit(" hr ago")))
        .otherwise(F.concat(days.cast("string"), F.lit(" days ago")))
    )


def hot_score(score: Column, comment_count: Column, created_ms: Column) -> Column:
    return score + comment_count * 2 + created_ms / F.lit(1e13)
