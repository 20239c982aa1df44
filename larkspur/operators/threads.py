"""Comment trees kept as flat rows: parents, depth, display order and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import enable_checkpoints, stored

# Posts and comments loaded for one company, and posts per comment look-up.
POSTS_MAX, COMMENTS_MAX, POSTS_PER_LOOKUP = 75, 700, 10


def active(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "active")


def latest_per_group(df: DataFrame, key: str, most: int, order: str = "created_ms") -> DataFrame:
    """The newest rows of each group. Spark limits each group before the shuffle."""
    newest = Window.partitionBy(key).orderBy(F.col(order).desc(), F.col("id").desc())
    # The cast comes last: on the bare row number Spark can limit each group early.
    ranked = df.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= most)
    return ranked.withColumn("place", F.col("place").cast("long"))


def wanted_posts(posts: DataFrame) -> DataFrame:
    """The newest active posts of each company (post_id, _company), each with its look-up and the comments that a look-up may load."""
    shown = latest_per_group(active(posts), "company_slug", POSTS_MAX)
    lookups = shown.groupBy("company_slug").agg(F.ceil(F.count("*") / POSTS_PER_LOOKUP).alias("_lookups"))
    return shown.join(lookups, "company_slug").select(
        F.col("id").alias("post_id"),
        F.col("company_slug").alias("_company"),
        F.floor((F.col("place") - 1) / POSTS_PER_LOOKUP).alias("_lookup"),
        F.ceil(F.lit(COMMENTS_MAX) / F.col("_lookups")).alias("_share"),
    )


def within_share(found: DataFrame, *company: str) -> DataFrame:
    """Comments of wanted posts that their look-up loads, oldest first.

    ``company`` names the column that the comments are stored by, if any: a company's posts then stay where they are.
    """
    oldest = Window.partitionBy(*company, "post_id").orderBy("created_ms", "id")
    in_lookup = Window.partitionBy(*(company or ("_company",)), "_lookup").orderBy("created_ms", "id")
    # The share is constant within a post, so the limit per post holds the look-up's first rows.
    return (
        found.withColumn("_in_post", F.row_number().over(oldest))
        .where(F.col("_in_post") <= F.col("_share"))
        .withColumn("_at", F.row_number().over(in_lookup))
        .where(F.col("_at") <= F.col("_share"))
        .drop("_in_post", "_at", "_company", "_lookup", "_share")
    )


def loaded_comments(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Active comments of the newest active posts of each company, oldest first.

    Posts are looked up ten at a time, and the comment limit of a company is shared among its look-ups. Comments of other
    posts leave before anything is ranked, and no post is ranked beyond its look-up's share.
    """
    return within_share(active(comments).join(wanted_posts(posts), "post_id"))


def attach_parents(comments: DataFrame) -> DataFrame:
    """Keep a parent only where it is among the given comments, of whatever post; else the comment is top level.

    Top-level rows skip the join: their NULL keys would all meet in one task. A parent with very many
    replies is split by Spark's skew join, as nothing after the join needs its partitioning.
    """
    ids = comments.select(F.col("id").alias("_known"))
    replies = comments.where(F.col("parent_id").isNotNull()).join(ids, F.col("parent_id") == F.col("_known"), "left")
    kept = replies.withColumn("parent_id", F.col("_known")).drop("_known")
    return kept.unionByName(comments.where(F.col("parent_id").isNull()))


def thread_paths(comments: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """Place of every comment in its tree: (id, post_id, root_post_id, depth, path, in_cycle).

    ``path`` holds (created_ms, id) from the top comment down, so ordering by root_post_id and path gives
    the display order. Each round doubles the distance a row has looked up its ancestors, so a tree of
    depth d takes about log2(d) rounds. A path that meets a comment twice is a cycle; such comments are
    flagged and never reached from a post. Only active comments take part, of ``posts`` if given; replies of a comment
    that does not are top level.
    """
    enable_checkpoints(comments.sparkSession)
    step = F.struct(F.col("created_ms").alias("created_ms"), F.col("id").alias("id"))
    shown = active(comments) if posts is None else active(comments).join(posts.select(F.col("id").alias("post_id")), "post_id", "left_semi")
    nodes = (
        attach_parents(shown.select("id", "post_id", "parent_id", "created_ms"))
        .select(
            "id", "post_id", F.col("parent_id").alias("_next"), F.array(step).alias("path"),
            F.col("post_id").alias("root_post_id"), (F.col("parent_id") == F.col("id")).alias("_loop"),
        )
        .withColumn("in_cycle", F.coalesce("_loop", F.lit(False)))
        .withColumn("_next", F.when(~F.col("in_cycle"), F.col("_next")))
        .drop("_loop")
        .checkpoint()
    )
    while not nodes.where(F.col("_next").isNotNull()).isEmpty():
        above = nodes.select(
            F.col("id").alias("_next"), F.col("_next").alias("_after"), F.col("path").alias("_path"),
            F.col("root_post_id").alias("_root"), F.col("in_cycle").alias("_cycle"),
        )
        longer = (
            nodes.where(F.col("_next").isNotNull())
            .join(above, "_next")
            .withColumn("path", F.concat("_path", "path"))
            .withColumn("in_cycle", F.col("_cycle") | (F.size(F.array_distinct("path")) < F.size("path")))
            .select(
                "id", "post_id", F.when(~F.col("in_cycle"), F.col("_after")).alias("_next"), "path",
                F.col("_root").alias("root_post_id"), "in_cycle",
            )
        )
        nodes = nodes.where(F.col("_next").isNull()).unionByName(longer).checkpoint()
    return nodes.select("id", "post_id", "root_post_id", (F.size("path") - 1).alias("depth"), "path", "in_cycle")


def thread_tree(comments: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """Reachable active comments in display order."""
    return thread_paths(comments, posts).where(~F.col("in_cycle")).drop("in_cycle").orderBy("root_post_id", "path")


DAY_MS = 86_400_000


def _sibling_links(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, _sibling) with the next comment under the same parent or post, and (_owner, _child) with the first one.

    Siblings go by (created_ms, id). They are sorted within each owner and day, and days are linked by one row each, so that
    the replies of one comment, however many, are not sorted by one task.
    """
    day = F.floor(F.col("created_ms") / DAY_MS)
    in_day = Window.partitionBy("_owner", "_day").orderBy("created_ms", "id")
    placed = nodes.withColumn("_day", day).withColumn("_sibling", F.lead("id").over(in_day))
    heads = placed.groupBy("_owner", "_day").agg(F.min_by("id", F.struct("created_ms", "id")).alias("_child"))
    days = Window.partitionBy("_owner").orderBy(F.col("_day").asc_nulls_first())
    linked = heads.withColumn("_then", F.lead("_child").over(days)).withColumn("_first", F.lag(F.lit(1)).over(days).isNull())
    ends = placed.where(F.col("_sibling").isNull()).drop("_sibling").alias("e").join(
        linked.alias("d"), (F.col("e._owner") == F.col("d._owner")) & F.col("e._day").eqNullSafe(F.col("d._day"))
    )
    siblings = placed.where(F.col("_sibling").isNotNull()).select("id", "_sibling").unionByName(
        ends.select(F.col("e.id").alias("id"), F.col("d._then").alias("_sibling"))
    )
    return siblings, linked.where("_first").select("_owner", "_child")


def thread_order(comments: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """Place of every comment in its tree, in rows of constant width: (id, post_id, root_post_id, depth, place, in_cycle).

    ``place`` counts from 1 in display order below the post that the top comment stands under; ``depth`` is 0 at the top.
    It is list ranking on the Euler tour: each comment is entered and left once, entering leads to its first reply, leaving to its next
    sibling or to leaving its parent. Each round every step takes over what the step it points to has summed up (comments
    entered, change of depth) and points where that one points, so a tour of n steps takes log2(n) rounds, and a row holds four
    numbers however deep it is. Steps that never reach an end belong to cycles or hang below one; such comments are flagged,
    without post, depth and place.

    Takes part who does in ``thread_paths``. Comments of one id must be one row.
    """
    shown = active(comments) if posts is None else active(comments).join(posts.select(F.col("id").alias("post_id")), "post_id", "left_semi")
    owner = F.when(F.col("parent_id").isNull(), F.concat(F.lit("post "), F.col("post_id").cast("string"))).otherwise(
        F.concat(F.lit("comment "), F.col("parent_id").cast("string"))
    )
    nodes = stored(attach_parents(shown.select("id", "post_id", "parent_id", "created_ms")).withColumn("_owner", owner), "comments")
    siblings, children = _sibling_links(nodes)
    own = F.concat(F.lit("comment "), F.col("id").cast("string"))
    linked = nodes.withColumn("_own", own).join(siblings, "id").join(children.withColumnRenamed("_owner", "_own"), "_own", "left")

    def step(enters: bool, next_id: Column, next_enters: Column) -> Column:
        change = 1 if enters else -1
        return F.struct(
            F.lit(enters).alias("enters"), next_id.alias("next_id"), next_enters.alias("next_enters"),
            F.lit(int(enters)).cast("long").alias("entered"), F.lit(change).cast("long").alias("change"),
            F.when(next_id.isNull(), F.col("post_id")).alias("root_post_id"),
        )

    has_child, has_sibling = F.col("_child").isNotNull(), F.col("_sibling").isNotNull()
    steps = stored(
        linked.select(
            "id",
            F.inline(
                F.array(
                    step(True, F.coalesce("_child", "id"), has_child),
                    step(False, F.coalesce("_sibling", "parent_id"), has_sibling),
                )
            ),
        ),
        "tour",
    )
    unsettled, before = steps.where(F.col("next_id").isNotNull()).count(), -1
    while unsettled and unsettled != before:
        # The rest of a tour is no shorter than a round reaches until its last step has settled, so a round that settles
        # nothing leaves only steps without an end.
        then = steps.select(
            F.col("id").alias("next_id"), F.col("enters").alias("next_enters"), F.col("next_id").alias("_id"), F.col("next_enters").alias("_enters"),
            F.col("entered").alias("_entered"), F.col("change").alias("_change"), F.col("root_post_id").alias("_root"),
        )
        moved = steps.where(F.col("next_id").isNotNull()).join(then, ["next_id", "next_enters"])
        moved = moved.select(
            "id", "enters", F.col("_id").alias("next_id"), F.col("_enters").alias("next_enters"), (F.col("entered") + F.col("_entered")).alias("entered"),
            (F.col("change") + F.col("_change")).alias("change"), F.col("_root").alias("root_post_id"),
        )
        steps = stored(steps.where(F.col("next_id").isNull()).unionByName(moved), "tour")
        before, unsettled = unsettled, steps.where(F.col("next_id").isNotNull()).count()
    entered = steps.where("enters").select("id", "next_id", "entered", "change", "root_post_id")
    totals = entered.where(F.col("next_id").isNull()).groupBy("root_post_id").agg(F.max("entered").alias("_total"))
    ranked = entered.join(totals, "root_post_id", "left").select(
        "id", F.when(F.col("next_id").isNull(), F.col("root_post_id")).alias("root_post_id"),
        F.when(F.col("next_id").isNull(), -F.col("change")).alias("depth"),
        F.when(F.col("next_id").isNull(), F.col("_total") - F.col("entered") + 1).alias("place"),
        F.col("next_id").isNotNull().alias("in_cycle"),
    )
    return nodes.select("id", "post_id").join(ranked, "id").select("id", "post_id", "root_post_id", "depth", "place", "in_cycle")


def comment_counts(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Comments of each post at any depth; the stored number wins where it is larger."""
    counted = active(comments).groupBy("post_id").agg(F.count("*").alias("_n"))
    joined = posts.join(counted, posts["id"] == counted["post_id"], "left").drop("post_id")
    larger = F.greatest(F.coalesce("comment_count", F.lit(0)), F.coalesce("_n", F.lit(0))).cast("long")
    return joined.withColumn("comment_count", larger).drop("_n")


def tree_counts(posts: DataFrame, paths: DataFrame) -> DataFrame:
    """As comment_counts, but a reply counts for the post its top comment stands under, and cycles for none."""
    counted = paths.where(~F.col("in_cycle")).groupBy("root_post_id").agg(F.count("*").alias("_n"))
    joined = posts.join(counted, posts["id"] == counted["root_post_id"], "left").drop("root_post_id")
    larger = F.greatest(F.coalesce("comment_count", F.lit(0)), F.coalesce("_n", F.lit(0))).cast("long")
    return joined.withColumn("comment_count", larger).drop("_n")


def find_comment(comments: DataFrame, comment_id) -> DataFrame:
    return comments.where(F.col("id") == comment_id)


def comments_of(comments: DataFrame, author_uid: str) -> DataFrame:
    return comments.where(F.col("author_uid") == author_uid)


def flatten_threads(posts: DataFrame) -> DataFrame:
    """Flat rows (kind, id, post_id, parent_id, ...) from nested posts with comments and replies.

    ``comments`` and ``replies`` are arrays of structs, nested as deep as the schema says.
    """
    shared = ["id", "company_slug", "body", "author_uid", "author_name", "created_ms"]
    likes = F.greatest(F.lit(0).cast("long"), F.coalesce(F.col("score"), F.lit(0)).cast("long")).alias("upvotes")
    none = F.lit(None).cast(dict(posts.dtypes)["id"])

    def rows(df: DataFrame, kind: str) -> DataFrame:
        title = F.col("title") if kind == "post" else F.lit(None).cast("string")
        return df.select(F.lit(kind).alias("kind"), *shared, title.alias("title"), "post_id", "parent_id", likes)

    level = posts.withColumns({"post_id": F.col("id"), "parent_id": none})
    out, children, kind = rows(level, "post"), "comments", "comment"
    while children in level.columns:
        parent = none if children == "comments" else F.col("id")
        level = level.select(
            F.col("company_slug"), F.col("post_id"), parent.alias("parent_id"), F.explode(children).alias("_c")
        ).select("company_slug", "post_id", "parent_id", "_c.*")
        out, children = out.unionByName(rows(level, kind)), "replies"
    return out
