"""Posts, comments, profiles and votes as tables: normalisation, validation, ranking and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import forum as fo
from larkspur.functions import text as tx
from larkspur.functions.times import utc_timestamp
from larkspur.operators.companies import with_post_company
from larkspur.operators.listings import first_per_key
from larkspur.operators.ordered import with_previous
from larkspur.operators.threads import POSTS_MAX, active, comment_counts, latest_per_group, loaded_comments
from larkspur.operators.votes import with_my_vote

# Default texts, profile lengths and rows shown on a profile.
POST_TITLE, MEMBER_NAME = "Untitled thread", "Community Member"
NAME_MAX, HEADLINE_MAX, BIO_MAX = 80, 120, 500
ACTIVITY_MAX = 20
STATS = ("posts", "comments", "votes_cast", "karma")


def _text(df: DataFrame, *names: str, default: str = "") -> Column:
    """First filled of the columns present, else the default."""
    found = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in found], F.lit(default))


def _optional(df: DataFrame, name: str) -> Column:
    return F.nullif(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit(None).cast("string")


def _millis(df: DataFrame, name: str, now_ms: int) -> Column:
    """A time column that may hold a number, a timestamp or text."""
    if name not in df.columns:
        return F.lit(now_ms).cast("long")
    kind = dict(df.dtypes)[name]
    if kind == "string":
        return F.coalesce(tx.date_millis(F.col(name)), F.lit(now_ms)).cast("long")
    if kind.startswith("timestamp"):
        return F.coalesce(F.unix_millis(utc_timestamp(df, name)), F.lit(now_ms)).cast("long")
    return fo.time_millis(F.col(name), F.lit(None).cast("long"), now_ms)


def _generated_id(df: DataFrame, prefix: str) -> Column:
    """The id, or one made from the row where it is missing."""
    content = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in sorted(df.columns)]), 256)
    return _text_or(df, "id", F.concat(F.lit(f"{prefix}-"), F.substring(content, 1, 12)))


def _text_or(df: DataFrame, name: str, other: Column) -> Column:
    own = _optional(df, name)
    return F.coalesce(own, other)


def _number(df: DataFrame, name: str) -> Column:
    return tx.to_number(F.col(name).cast("string")) if name in df.columns else F.lit(0.0)


def normalize_posts(df: DataFrame, now_ms: int) -> DataFrame:
    created = _millis(df, "created_at", now_ms)
    updated = created
    if "updated_at" in df.columns:
        updated = F.when(F.col("updated_at").isNull() | (F.col("updated_at").cast("string") == ""), created).otherwise(
            _millis(df, "updated_at", now_ms)
        )
    return df.select(
        _generated_id(df, "p").alias("id"),
        _optional(df, "company_slug").alias("company_slug"),
        _text(df, "title", default=POST_TITLE).alias("title"),
        _text(df, "body").alias("body"),
        _text(df, "author_name", "author", default=MEMBER_NAME).alias("author_name"),
        _optional(df, "author_uid").alias("author_uid"),
        _text(df, "author_headline").alias("author_headline"),
        created.alias("created_ms"),
        updated.alias("updated_ms"),
        _number(df, "score").alias("score"),
        _number(df, "comment_count").alias("comment_count"),
        _text(df, "status", default="active").alias("status"),
    )


def normalize_comments(df: DataFrame, now_ms: int) -> DataFrame:
    return df.select(
        _generated_id(df, "c").alias("id"),
        _optional(df, "post_id").alias("post_id"),
        _optional(df, "company_slug").alias("company_slug"),
        _text(df, "body").alias("body"),
        _text(df, "author_name", "author", default=MEMBER_NAME).alias("author_name"),
        _optional(df, "author_uid").alias("author_uid"),
        _text(df, "author_headline").alias("author_headline"),
        _millis(df, "created_at", now_ms).alias("created_ms"),
        _number(df, "score").alias("score"),
        _optional(df, "parent_id").alias("parent_id"),
        _text(df, "status", default="active").alias("status"),
    )


def clean_posts(df: DataFrame) -> DataFrame:
    """Cleaned title and body; a post without title is rejected."""
    cleaned = df.withColumns(
        {
            "title": fo.clean_forum_text(F.col("title"), fo.TITLE_MAX),
            "body": fo.clean_forum_text(F.col("body"), fo.BODY_MAX),
        }
    )
    return cleaned.where("title <> ''")


def clean_comments(df: DataFrame) -> DataFrame:
    """Cleaned body; a comment without text is rejected."""
    return df.withColumn("body", fo.clean_forum_text(F.col("body"), fo.COMMENT_MAX)).where("body <> ''")


def sanitize_profiles(df: DataFrame) -> DataFrame:
    """Trimmed and cut profile texts; statistics of the user row win over those in the profile."""

    def cut(name: str, most: int, default: str = "") -> Column:
        return F.substring(tx.trim(_text(df, name, default=default)), 1, most)

    def stat(name: str) -> Column:
        found = [F.col(c) for c in (f"user_{name}", name) if c in df.columns]
        return F.coalesce(*found, F.lit(0)).cast("long")

    return df.select(
        _text(df, "uid", default="guest").alias("uid"),
        F.coalesce(F.nullif(cut("display_name", NAME_MAX), F.lit("")), F.lit(MEMBER_NAME)).alias("display_name"),
        cut("headline", HEADLINE_MAX).alias("headline"),
        cut("bio", BIO_MAX).alias("bio"),
        *[stat(s).alias(s) for s in STATS],
    )


def with_vote_keys(df: DataFrame) -> DataFrame:
    """Key and id of a vote from (target_type, company_slug, post_id, comment_id, target_id, user_uid)."""
    key = fo.vote_key(F.col("target_type"), F.col("company_slug"), F.col("post_id"), F.col("comment_id"))
    return df.withColumn("vote_key", key).withColumn(
        "vote_id", fo.vote_id(F.col("target_type"), F.col("target_id"), F.col("user_uid"))
    )


def _between(c: Column, low: int, high: int) -> Column:
    return F.coalesce(F.length(c).between(low, high), F.lit(False))


def _checked(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Add ``failed``, the names of the checks a row does not pass."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return df.withColumn("failed", failed)


def check_new_posts(df: DataFrame) -> DataFrame:
    return _checked(
        df,
        {
            "status": F.col("status") == "active",
            "company_slug": _between(F.col("company_slug"), 1, 140),
            "title": _between(F.col("title"), 1, 300),
            "body": _between(F.col("body"), 0, 6000),
            "score": F.col("score") == 1,
            "comment_count": F.col("comment_count") == 0,
        },
    )


def check_new_comments(df: DataFrame) -> DataFrame:
    return _checked(
        df,
        {
            "status": F.col("status") == "active",
            "company_slug": _between(F.col("company_slug"), 1, 140),
            "post_id": _between(F.col("post_id").cast("string"), 1, 180),
            "body": _between(F.col("body"), 1, 4000),
            "score": F.col("score") == 1,
        },
    )


def check_votes(df: DataFrame) -> DataFrame:
    return _checked(
        df,
        {
            "value": F.col("value").isin(-1, 1),
            "target_type": F.col("target_type").isin("post", "comment"),
            "company_slug": _between(F.col("company_slug"), 1, 140),
        },
    )


def check_updates(versions: DataFrame, chunk: str = "hour") -> DataFrame:
    """Versions (id, ts, seq, score, comment_count): score moves by at most 2, comment_count by 0 or 1."""
    cut = versions.withColumn("_chunk", F.date_trunc(chunk, "ts"))
    stepped = with_previous(cut, ["id"], ["ts", "seq"], ["score", "comment_count"], "_chunk").drop("_chunk")
    first = F.col("previous_score").isNull()
    score_step = F.col("score") - F.col("previous_score")
    count_step = F.col("comment_count") - F.col("previous_comment_count")
    return _checked(
        stepped, {"score": first | score_step.between(-2, 2), "comment_count": first | count_step.between(0, 1)}
    ).drop("previous_score", "previous_comment_count")


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("failed") == 0).drop("failed")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("failed") > 0)


def sort_posts(posts: DataFrame, mode: str = "hot") -> DataFrame:
    """Order by new, top or hot; ties by id."""
    return _scored(posts).orderBy(*_post_order(mode))


def rank_posts(posts: DataFrame, mode: str = "hot") -> DataFrame:
    """The same order as ``place`` within each company."""
    place = F.row_number().over(Window.partitionBy("company_slug").orderBy(*_post_order(mode))).cast("long")
    return _scored(posts).withColumn("place", place)


def _scored(posts: DataFrame) -> DataFrame:
    return posts.withColumn("hot_score", fo.hot_score(F.col("score"), F.col("comment_count"), F.col("created_ms")))


def _post_order(mode: str) -> list[Column]:
    keys = {"new": ["created_ms"], "top": ["score", "created_ms"]}.get(mode, ["hot_score"])
    return [*[F.col(k).desc() for k in keys], F.col("id").asc()]


def company_page(
    posts: DataFrame, comments: DataFrame, state: DataFrame, registry: DataFrame, company_slug: str, user_uid: str,
    mode: str = "hot",
) -> DataFrame:
    """The forum page of one company: its newest posts with comment counts, one member's votes and the company."""
    own = posts.where(F.col("company_slug") == company_slug)
    shown = latest_per_group(active(own), "company_slug", POSTS_MAX).drop("place")
    counted = comment_counts(shown, loaded_comments(own, comments))
    named = with_post_company(with_my_vote(counted, state, user_uid, "post"), registry)
    return sort_posts(named, mode)


def user_activity(users: DataFrame, posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Newest active posts and comments of each member beside the profile; members without any keep one row."""

    def newest(df: DataFrame, kind: str) -> DataFrame:
        rows = latest_per_group(active(df), "author_uid", ACTIVITY_MAX)
        return rows.select(F.col("author_uid").alias("uid"), F.lit(kind).alias("kind"), "place", "id", "created_ms")

    return users.join(newest(posts, "post").unionByName(newest(comments, "comment")), "uid", "left")


def merge_stores(stores: list[DataFrame]) -> DataFrame:
    """Posts of the current store, then legacy posts whose (company_slug, id) is not there yet; earlier store wins."""
    current = stores[0]
    legacy = None
    for place, store in enumerate(stores[1:]):
        tagged = store.withColumn("_store", F.struct(F.lit(place).alias("store"), F.col("ordinal").alias("ordinal")))
        legacy = tagged if legacy is None else legacy.unionByName(tagged)
    if legacy is None:
        return current
    key = F.struct("company_slug", "id")
    added = first_per_key(legacy, key, "_store").drop("_store")
    # Distinct keys are combined before the shuffle, however often the current store repeats one.
    there = current.select("company_slug", "id").distinct()
    return current.unionByName(added.join(there, ["company_slug", "id"], "left_anti"))
