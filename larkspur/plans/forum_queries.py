"""Queries over posts, comments, votes and members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import forum as fo
from larkspur.operators import companies as co
from larkspur.operators import forum as fm
from larkspur.operators import state as st
from larkspur.operators import threads as th
from larkspur.operators import votes as vo
from larkspur.plans import sqltext as q
from larkspur.plans.catalog import query
from larkspur.plans.views import table, view
from larkspur.session import run_dir
from larkspur.sources import forum_store

NOW = 1700005000000


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "posts")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "comments")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "vote_events")


# --- texts and normalisation ---------------------------------------------------------------------


def _clean_sql(x: str, most: int) -> str:
    flat = f"regexp_replace({x}, '{q.WS}+\\n', chr(10), 'g')"
    return f"substr({q.trim(f'''regexp_replace({flat}, '[ \\t][ \\t]+', ' ', 'g')''')}, 1, {most})"


def _text_rule(name: str, source: str, key: str, most: int) -> None:
    @query(name, q.with_ctes([source], f"SELECT {key}, {_clean_sql('text' if source == 'resumes' else 'body', most)} AS cleaned FROM {source}"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = F.col("text" if source == "resumes" else "body")
        return view(spark, sf_dir, source).select(key, fo.clean_forum_text(text, most).alias("cleaned"))


_text_rule("n14_clean_body", "resumes", "doc_id", fo.BODY_MAX)
_text_rule("n14_clean_comment", "comments", "id", fo.COMMENT_MAX)


@query(
    "n14_clean_posts",
    q.with_ctes(
        ["posts"],
        f"SELECT * FROM (SELECT id, {_clean_sql('''CASE WHEN id % 9 = 0 THEN concat(' ', chr(10)) ELSE title END''', 300)} AS title, "
        f"{_clean_sql('body', 6000)} AS body FROM posts) WHERE title <> ''",
    ),
)
def cleaned_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.when(F.col("id") % 9 == 0, " \n").otherwise(F.col("title"))
    return fm.clean_posts(posts(spark, sf_dir).withColumn("title", blank)).select("id", "title", "body")


@query(
    "n15_normalize_posts",
    q.with_ctes(
        ["posts"],
        f"""SELECT CAST(id AS VARCHAR) AS id, company_slug, CASE WHEN id % 7 = 0 THEN 'Untitled thread' ELSE title END AS title, body,
        CASE WHEN id % 5 = 0 THEN 'Community Member' ELSE author_name END AS author_name, author_uid, '' AS author_headline,
        CASE WHEN id % 4 = 0 THEN {NOW} ELSE created_ms END AS created_ms,
        CASE WHEN id % 3 = 0 THEN created_ms + 5 WHEN id % 4 = 0 THEN {NOW} ELSE created_ms END AS updated_ms,
        CAST(CASE WHEN id % 6 = 0 THEN 0 ELSE 1 END AS DOUBLE) AS score, CAST(0 AS DOUBLE) AS comment_count,
        CASE WHEN id % 8 = 0 THEN 'active' ELSE status END AS status FROM posts""",
    ),
)
def normal_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def blank(every: int, name: str):
        return F.when(F.col("id") % every != 0, F.col(name))

    rough = posts(spark, sf_dir).select(
        "id", "company_slug", blank(7, "title").alias("title"), "body", blank(5, "author_name").alias("author"),
        "author_uid", blank(4, "created_ms").alias("created_at"),
        F.when(F.col("id") % 3 == 0, F.col("created_ms") + 5).alias("updated_at"), blank(6, "score").alias("score"),
        "comment_count", blank(8, "status").alias("status"),
    )
    return fm.normalize_posts(rough, NOW)


@query(
    "n15_normalize_comments",
    q.with_ctes(
        ["comments"],
        """SELECT CAST(id AS VARCHAR) AS id, CAST(post_id AS VARCHAR) AS post_id, company_slug, body, 'Community Member' AS author_name,
        author_uid, '' AS author_headline, created_ms, CAST(score AS DOUBLE) AS score, CAST(parent_id AS VARCHAR) AS parent_id, status FROM comments""",
    ),
)
def normal_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm.normalize_comments(comments(spark, sf_dir).withColumnRenamed("created_ms", "created_at"), NOW)


_MEMBERS = """members AS (SELECT author_uid AS uid, concat('  ', max(author_name), ' ') AS display_name,
  concat(' ', max(title)) AS headline, max(body) AS bio, count(*) AS posts FROM posts GROUP BY author_uid)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).groupBy(F.col("author_uid").alias("uid")).agg(
        F.concat(F.lit("  "), F.max("author_name"), F.lit(" ")).alias("display_name"),
        F.concat(F.lit(" "), F.max("title")).alias("headline"),
        F.max("body").alias("bio"),
        F.count("*").alias("posts"),
    )


@query(
    "n16_sanitize_profile",
    q.with_ctes(
        ["posts"],
        f"""SELECT uid, substr({q.trim('display_name')}, 1, 80) AS display_name, substr({q.trim('headline')}, 1, 120) AS headline,
        substr({q.trim('bio')}, 1, 500) AS bio, posts + 1 AS posts, CAST(0 AS BIGINT) AS comments, CAST(0 AS BIGINT) AS votes_cast,
        CAST(0 AS BIGINT) AS karma FROM members""",
        _MEMBERS,
    ),
)
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm.sanitize_profiles(members(spark, sf_dir).withColumn("user_posts", F.col("posts") + 1))


_VOTE_ROWS = """vote_rows AS (SELECT seq, user_uid, target_type, target_id, delta AS value, concat('c', CAST(target_id % 10 AS VARCHAR)) AS company_slug,
  target_id AS post_id FROM vote_events)"""


def vote_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes(spark, sf_dir).select(
        "seq", "user_uid", "target_type", "target_id", F.col("delta").alias("value"),
        F.concat(F.lit("c"), (F.col("target_id") % 10).cast("string")).alias("company_slug"),
        F.col("target_id").alias("post_id"), F.lit(None).cast("bigint").alias("comment_id"),
    )


@query(
    "n17_vote_keys",
    q.with_ctes(
        ["vote_events"],
        """SELECT seq, concat(target_type, ':', company_slug, ':', CAST(post_id AS VARCHAR), ':') AS vote_key,
        substr(regexp_replace(concat(target_type, '_', CAST(target_id AS VARCHAR), '_', user_uid, '@x.y'), '[^A-Za-z0-9_-]', '_', 'g'), 1, 240) AS vote_id
        FROM vote_rows""",
        _VOTE_ROWS,
    ),
)
def vote_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vote_rows(spark, sf_dir).withColumn("user_uid", F.concat("user_uid", F.lit("@x.y")))
    return fm.with_vote_keys(rows).select("seq", "vote_key", "vote_id")


@query(
    "n19_flatten_threads",
    q.with_ctes(
        ["comments"],
        """SELECT 'post' AS kind, id, company_slug, body, author_uid, 'A' AS author_name, created_ms, concat('T', CAST(id AS VARCHAR)) AS title,
          id AS post_id, CAST(NULL AS BIGINT) AS parent_id, CAST(3 AS BIGINT) AS upvotes FROM comments
        UNION ALL SELECT 'comment', id + 1000000000, company_slug, concat(body, ' b'), author_uid, 'B', created_ms + 1, NULL, id, NULL, 0 FROM comments
        UNION ALL SELECT 'comment', id + 2000000000, company_slug, concat(body, ' c'), author_uid, 'C', created_ms + 2, NULL, id, id + 1000000000, 2 FROM comments""",
    ),
)
def flat_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One nested document per row: a post with one comment, which has one reply.
    def node(shift: int, body, name: str, score: int, **children):
        return F.struct(
            (F.col("id") + shift).alias("id"), body.alias("body"), F.col("author_uid"), F.lit(name).alias("author_name"),
            (F.col("created_ms") + shift // 1000000000).alias("created_ms"), F.lit(score).cast("long").alias("score"),
            *[F.array(c).alias(k) for k, c in children.items()],
        )

    reply = node(2000000000, F.concat("body", F.lit(" c")), "C", 2)
    comment = node(1000000000, F.concat("body", F.lit(" b")), "B", -4, replies=reply)
    nested = comments(spark, sf_dir).select(
        "id", "company_slug", "body", "author_uid", F.lit("A").alias("author_name"), "created_ms",
        F.concat(F.lit("T"), F.col("id").cast("string")).alias("title"), F.lit(3).cast("long").alias("score"),
        F.array(comment).alias("comments"),
    )
    return th.flatten_threads(nested)


@query(
    "n20_age_label",
    q.with_ctes(
        ["comments"],
        f"""SELECT id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN concat(CAST(m AS VARCHAR), ' min ago')
        WHEN m < 2880 THEN concat(CAST(m // 60 AS VARCHAR), ' hr ago') ELSE concat(CAST(m // 1440 AS VARCHAR), ' days ago') END AS age
        FROM (SELECT id, greatest(0, {NOW} - (created_ms - (id % 50) * 8000000)) // 60000 AS m FROM comments)""",
    ),
)
def ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments(spark, sf_dir).select(
        "id", fo.age_label(F.col("created_ms") - (F.col("id") % 50) * 8000000, NOW).alias("age")
    )


# --- filters and checks --------------------------------------------------------------------------


@query("f6_active_posts", q.with_ctes(["posts"], "SELECT id, company_slug, status FROM posts WHERE status = 'active'"))
def active_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return th.active(posts(spark, sf_dir)).select("id", "company_slug", "status")


@query(
    "f8_check_posts",
    q.with_ctes(
        ["posts"],
        """SELECT id, concat_ws(',', CASE WHEN status <> 'active' THEN 'status' END, CASE WHEN length(title) NOT BETWEEN 1 AND 300 THEN 'title' END,
        CASE WHEN length(body) > 6000 THEN 'body' END, CASE WHEN id % 6 = 5 THEN 'score' END) AS failed FROM posts""",
    ),
)
def checked_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = posts(spark, sf_dir).withColumn("score", F.when(F.col("id") % 6 == 5, 2).otherwise(1))
    return fm.check_new_posts(rows).select("id", F.array_join("failed", ",").alias("failed"))


@query(
    "f8_check_comments",
    q.with_ctes(
        ["comments"],
        """SELECT id, concat_ws(',', CASE WHEN status <> 'active' THEN 'status' END, CASE WHEN id % 10 = 3 THEN 'company_slug' END, CASE WHEN length(body) NOT BETWEEN 1 AND 4000 THEN 'body' END) AS failed FROM comments""",
    ),
)
def checked_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = comments(spark, sf_dir).withColumn("company_slug", F.when(F.col("id") % 10 == 3, "").otherwise(F.col("company_slug")))
    return fm.check_new_comments(rows).select("id", F.array_join("failed", ",").alias("failed"))


@query(
    "f8_accepted_votes",
    q.with_ctes(["vote_events"], "SELECT seq, user_uid, value FROM vote_rows WHERE seq % 7 <> 0", _VOTE_ROWS),
)
def good_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vote_rows(spark, sf_dir).withColumn("value", F.when(F.col("seq") % 7 == 0, 2).otherwise(F.col("value")))
    return fm.accepted(fm.check_votes(rows)).select("seq", "user_uid", "value")


_VERSIONS = """versions AS (SELECT event_id % 40 AS id, ts, event_id AS seq, user_id % 4 AS score, event_id % 3 AS comment_count FROM events)"""


@query(
    "f8_check_updates",
    "WITH " + _VERSIONS + """, stepped AS (SELECT *, score - lag(score) OVER w AS s, comment_count - lag(comment_count) OVER w AS c
      FROM versions WINDOW w AS (PARTITION BY id ORDER BY ts, seq))
    SELECT id, seq, concat_ws(',', CASE WHEN abs(s) > 2 THEN 'score' END, CASE WHEN c NOT IN (0, 1) THEN 'comment_count' END) AS failed FROM stepped""",
)
def checked_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "events").select(
        (F.col("event_id") % 40).alias("id"), "ts", F.col("event_id").alias("seq"),
        (F.col("user_id") % 4).alias("score"), (F.col("event_id") % 3).alias("comment_count"),
    )
    return fm.check_updates(versions).select("id", "seq", F.array_join("failed", ",").alias("failed"))


# --- joins ---------------------------------------------------------------------------------------

_LOADED = """shown AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_slug ORDER BY created_ms DESC, id DESC) AS rn
  FROM posts WHERE status = 'active') WHERE rn <= 75),
shares AS (SELECT company_slug, ceil(700 / ceil(count(*) / 10.0)) AS share FROM shown GROUP BY company_slug),
loaded AS (SELECT c.* FROM comments c JOIN shown s ON c.post_id = s.id JOIN shares h ON h.company_slug = s.company_slug WHERE c.status = 'active'
  QUALIFY row_number() OVER (PARTITION BY s.company_slug, (s.rn - 1) // 10 ORDER BY c.created_ms, c.id) <= max(h.share) OVER (PARTITION BY s.company_slug))"""


@query("j4_loaded_comments", q.with_ctes(["posts", "comments"], "SELECT id, post_id, parent_id, company_slug, created_ms FROM loaded", _LOADED))
def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return th.loaded_comments(posts(spark, sf_dir), comments(spark, sf_dir)).select(
        "id", "post_id", "parent_id", "company_slug", "created_ms"
    )


@query(
    "j4_company_comments",
    q.with_ctes(
        ["posts", "comments"],
        "SELECT l.id, l.post_id, l.parent_id, l.company_slug, l.created_ms FROM loaded l JOIN posts p ON p.id = l.post_id WHERE p.company_slug = 'c3'", _LOADED,
    ),
)
def company_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "forum")
    forum_store.land_forum(posts(spark, sf_dir), comments(spark, sf_dir), path, buckets=8)
    return forum_store.company_comments(spark, path, "c3").select("id", "post_id", "parent_id", "company_slug", "created_ms")


_LINKED = "linked AS (SELECT c.id, c.post_id, p.id AS parent_id, c.created_ms FROM comments c LEFT JOIN comments p ON c.parent_id = p.id)"


@query("j5_attach_parents", q.with_ctes(["comments"], "SELECT id, post_id, parent_id, created_ms FROM linked", _LINKED))
def attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return th.attach_parents(comments(spark, sf_dir).select("id", "post_id", "parent_id", "created_ms"))


_ISLANDS = """marked AS (SELECT *, CASE WHEN delta = lag(delta) OVER w THEN 0 ELSE 1 END AS starts FROM cast_votes
  WINDOW w AS (PARTITION BY user_uid, target_type, target_id ORDER BY first, ts, seq)),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY user_uid, target_type, target_id ORDER BY first, ts, seq) AS run FROM marked),
run_sizes AS (SELECT user_uid, target_type, target_id, run, min(delta) AS delta, count(*) AS n FROM runs GROUP BY user_uid, target_type, target_id, run),
vote_state AS (SELECT user_uid, target_type, target_id, CASE WHEN n % 2 = 1 THEN delta ELSE 0 END AS value FROM run_sizes
  QUALIFY row_number() OVER (PARTITION BY user_uid, target_type, target_id ORDER BY run DESC) = 1)"""
_EVENTS_ONLY = "cast_votes AS (SELECT 1 AS first, seq, ts, user_uid, target_type, target_id, delta FROM vote_events)"
_WITH_CREATED = """cast_votes AS (SELECT 1 AS first, seq, ts, user_uid, target_type, target_id, delta FROM vote_events
  UNION ALL SELECT 0, -1, TIMESTAMP '2000-01-01', author_uid, 'post', id, 1 FROM posts
  UNION ALL SELECT 0, -1, TIMESTAMP '2000-01-01', author_uid, 'comment', id, 1 FROM comments)"""


def full_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vo.vote_state(vo.all_votes(posts(spark, sf_dir), comments(spark, sf_dir), votes(spark, sf_dir)))


@query("a10_vote_state", q.with_ctes(["vote_events"], "SELECT * FROM vote_state", _EVENTS_ONLY, _ISLANDS))
def event_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vo.vote_state(votes(spark, sf_dir))


_FULL = ["posts", "comments", "vote_events"]


@query("a10_vote_state_with_authors", q.with_ctes(_FULL, "SELECT * FROM vote_state", _WITH_CREATED, _ISLANDS))
def authors_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_state(spark, sf_dir)


@query(
    "a11_scores",
    q.with_ctes(_FULL, "SELECT target_type, target_id, CAST(sum(value) AS BIGINT) AS score FROM vote_state GROUP BY target_type, target_id", _WITH_CREATED, _ISLANDS),
)
def target_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vo.scores(full_state(spark, sf_dir))


_STATS = """stats AS (SELECT uid, CAST(sum(p) AS BIGINT) AS posts, CAST(sum(c) AS BIGINT) AS comments, CAST(sum(v) AS BIGINT) AS votes_cast, CAST(sum(k) AS BIGINT) AS karma FROM (
  SELECT author_uid AS uid, 1 AS p, 0 AS c, 0 AS v, 1 AS k FROM posts UNION ALL SELECT author_uid, 0, 1, 0, 1 FROM comments
  UNION ALL SELECT user_uid, 0, 0, 1, 0 FROM vote_state WHERE value <> 0) GROUP BY uid)"""


MEMBER_STATS = q.with_ctes(_FULL, "SELECT * FROM stats", _WITH_CREATED, _ISLANDS, _STATS)


@query("a12_user_stats", MEMBER_STATS)
def user_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vo.member_stats(posts(spark, sf_dir), comments(spark, sf_dir), full_state(spark, sf_dir))


@query(
    "a12_shown_stats",
    q.with_ctes(
        _FULL,
        """SELECT s.uid, greatest(s.posts, coalesce(m.posts * 3, 0)) AS posts, s.comments, greatest(s.votes_cast, coalesce(m.posts, 0)) AS votes_cast,
        coalesce(m.posts, 0) AS karma FROM stats s LEFT JOIN members m ON s.uid = m.uid""",
        _WITH_CREATED, _ISLANDS, _STATS, _MEMBERS,
    ),
)
def larger_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = members(spark, sf_dir).select(
        "uid", (F.col("posts") * 3).alias("posts"), F.lit(0).cast("long").alias("comments"),
        F.col("posts").alias("votes_cast"), F.col("posts").alias("karma"),
    )
    return vo.shown_stats(stored, user_stats(spark, sf_dir))


@query(
    "j6_my_votes",
    q.with_ctes(
        ["posts", "vote_events"],
        """SELECT p.id, p.company_slug, coalesce(v.delta, 0) AS my_vote FROM posts p LEFT JOIN vote_events v ON v.seq = p.id AND v.seq % 3 = 0""",
    ),
)
def my_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # All votes as one member's, on a target each, two of three on comments: far more than any page shows.
    cast = votes(spark, sf_dir).withColumns(
        {"user_uid": F.lit("u7"), "target_id": F.col("seq"), "target_type": F.when(F.col("seq") % 3 == 0, "post").otherwise("comment")}
    )
    rows = posts(spark, sf_dir).select("id", "company_slug")
    return vo.with_my_vote(rows, vo.vote_state(cast), "u7", "post")


_REGISTRY = f"""registry AS (SELECT ordinal, CASE WHEN rank = 0 THEN place ELSE rank END AS rank, name,
  CASE WHEN industry = '' THEN {q.infer_industry('name')} ELSE industry END AS industry, {q.slug('name')} AS slug,
  coalesce(nullif(domain, ''), (SELECT o.domain FROM domain_overrides o WHERE o.name = c.name), {q.domain_guess('name', co.tx.REGISTRY_STOP_WORDS)}) AS domain,
  CAST(NULL AS DOUBLE) AS revenue_millions, CAST(NULL AS BIGINT) AS employees, '' AS headquarters, '' AS state
  FROM (SELECT *, row_number() OVER (ORDER BY ordinal) AS place FROM companies ORDER BY ordinal LIMIT 500) c)"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.normalize_companies(view(spark, sf_dir, "companies"), view(spark, sf_dir, "domain_overrides"))


def _slugged(df: DataFrame) -> DataFrame:
    # Half of the posts belong to a company of the registry.
    known = F.concat(F.lit("customer-"), F.lpad((F.col("id") % 10).cast("string"), 9, "0"))
    return df.withColumn("company_slug", F.when(F.col("id") % 2 == 0, known).otherwise(F.concat(F.lit("new-"), "company_slug")))


@query(
    "j7_post_company",
    q.with_ctes(
        ["posts", "companies", "domain_overrides"],
        """SELECT p.id, p.s AS company_slug, coalesce(r.name, replace(p.s, '-', ' ')) AS company_name, coalesce(r.industry, 'Company') AS company_industry
        FROM (SELECT *, CASE WHEN id % 2 = 0 THEN concat('customer-', lpad(CAST(id % 10 AS VARCHAR), 9, '0')) ELSE concat('new-', company_slug) END AS s FROM posts) p
        LEFT JOIN registry r ON r.slug = p.s""",
        _REGISTRY,
    ),
)
def post_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = co.with_post_company(_slugged(posts(spark, sf_dir)), registry(spark, sf_dir))
    return found.select("id", "company_slug", "company_name", "company_industry")


@query(
    "j8_user_activity",
    q.with_ctes(
        ["posts", "comments"],
        """SELECT m.uid, m.posts, a.kind, a.place, a.id, a.created_ms FROM members m LEFT JOIN (
          SELECT author_uid AS uid, 'post' AS kind, row_number() OVER (PARTITION BY author_uid ORDER BY created_ms DESC, id DESC) AS place, id, created_ms
            FROM posts WHERE status = 'active'
          UNION ALL SELECT author_uid, 'comment', row_number() OVER (PARTITION BY author_uid ORDER BY created_ms DESC, id DESC), id, created_ms
            FROM comments WHERE status = 'active') a ON a.uid = m.uid AND a.place <= 20""",
        _MEMBERS,
    ),
)
def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm.user_activity(members(spark, sf_dir).select("uid", "posts"), posts(spark, sf_dir), comments(spark, sf_dir))


# --- counts, order, trees ------------------------------------------------------------------------

_COUNTED = """counted AS (SELECT p.id, p.company_slug, p.created_ms, p.score, greatest(p.id % 4, coalesce(c.n, 0)) AS comment_count
  FROM posts p LEFT JOIN (SELECT post_id, count(*) AS n FROM comments WHERE status = 'active' GROUP BY post_id) c ON c.post_id = p.id)"""


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = posts(spark, sf_dir).select("id", "company_slug", "created_ms", "score", (F.col("id") % 4).alias("comment_count"))
    return th.comment_counts(stored, comments(spark, sf_dir))


@query("a9_comment_counts", q.with_ctes(["posts", "comments"], "SELECT * FROM counted", _COUNTED))
def post_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir)


def _order_query(mode: str, order: str) -> None:
    scored = "SELECT *, score + comment_count * 2 + created_ms / 1e13 AS hot_score FROM counted"
    sql = f"SELECT *, row_number() OVER (PARTITION BY company_slug ORDER BY {order}, id) AS place FROM ({scored})"

    @query(f"o2_posts_{mode}", q.with_ctes(["posts", "comments"], sql, _COUNTED))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fm.rank_posts(counted(spark, sf_dir), mode)


for _mode, _order in (("hot", "hot_score DESC"), ("new", "created_ms DESC"), ("top", "score DESC, created_ms DESC")):
    _order_query(_mode, _order)


@query(
    "w3_latest_posts",
    q.with_ctes(
        ["posts"],
        """SELECT id, company_slug, place FROM (SELECT id, company_slug, row_number() OVER (PARTITION BY company_slug ORDER BY created_ms DESC, id DESC) AS place
        FROM posts WHERE status = 'active') WHERE place <= 75""",
    ),
)
def latest_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return th.latest_per_group(th.active(posts(spark, sf_dir)), "company_slug", th.POSTS_MAX).select("id", "company_slug", "place")


_SHOWN = """linked AS (SELECT c.id, c.post_id, p.id AS parent_id, c.created_ms FROM (SELECT * FROM comments WHERE status = 'active') c
  LEFT JOIN (SELECT * FROM comments WHERE status = 'active') p ON c.parent_id = p.id)"""
_TREE = """tree AS (SELECT id, post_id, post_id AS root_post_id, 0 AS depth, concat(CAST(created_ms AS VARCHAR), ':', CAST(id AS VARCHAR)) AS path
  FROM linked WHERE parent_id IS NULL
  UNION ALL SELECT l.id, l.post_id, t.root_post_id, t.depth + 1, concat(t.path, '/', CAST(l.created_ms AS VARCHAR), ':', CAST(l.id AS VARCHAR))
  FROM linked l JOIN tree t ON l.parent_id = t.id)"""


@query(
    "t1_thread_tree",
    q.with_ctes(["comments"], "SELECT id, post_id, root_post_id, depth, path FROM tree", _SHOWN, _TREE).replace("WITH ", "WITH RECURSIVE ", 1),
)
def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.transform("path", lambda s: F.concat_ws(":", s["created_ms"].cast("string"), s["id"].cast("string")))
    return th.thread_tree(comments(spark, sf_dir)).withColumn("path", F.array_join(steps, "/"))


@query(
    "t1_thread_order",
    q.with_ctes(
        ["comments"],
        "SELECT id, post_id, root_post_id, depth, row_number() OVER (PARTITION BY root_post_id ORDER BY path) AS place FROM tree",
        _SHOWN,
        """tree AS (SELECT id, post_id, post_id AS root_post_id, CAST(0 AS BIGINT) AS depth, [created_ms, id] AS path FROM linked WHERE parent_id IS NULL
        UNION ALL SELECT l.id, l.post_id, t.root_post_id, t.depth + 1, t.path || [l.created_ms, l.id] FROM linked l JOIN tree t ON l.parent_id = t.id)""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def tree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return th.thread_order(comments(spark, sf_dir)).where(~F.col("in_cycle")).drop("in_cycle")


@query(
    "a9_tree_counts",
    q.with_ctes(
        ["posts", "comments"],
        "SELECT p.id, greatest(p.comment_count, coalesce(t.n, 0)) AS comment_count FROM posts p LEFT JOIN (SELECT root_post_id, count(*) AS n FROM tree GROUP BY root_post_id) t ON t.root_post_id = p.id",
        _SHOWN, _TREE,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def counts_from_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = th.thread_order(comments(spark, sf_dir))
    return th.tree_counts(posts(spark, sf_dir).select("id", "comment_count"), placed)


@query("t2_comments_of_author", q.with_ctes(["comments"], "SELECT id, post_id, body FROM comments WHERE author_uid = 'u9'"))
def by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return th.comments_of(comments(spark, sf_dir), "u9").select("id", "post_id", "body")


@query("t2_find_comment", q.with_ctes(["comments"], "SELECT id, post_id, body FROM comments WHERE id = 4001"))
def by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return th.find_comment(comments(spark, sf_dir), 4001).select("id", "post_id", "body")


# --- sets ----------------------------------------------------------------------------------------


@query(
    "u1_merge_stores",
    q.with_ctes(
        ["posts"],
        """SELECT id, company_slug, store FROM (
          SELECT id, company_slug, 'current' AS store FROM posts WHERE id % 3 <> 0
          UNION ALL SELECT id, company_slug, 'first' FROM posts WHERE id % 3 = 0 AND id % 2 = 0
          UNION ALL SELECT id, company_slug, 'second' FROM posts WHERE id % 3 = 0 AND id % 2 <> 0)""",
    ),
)
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = posts(spark, sf_dir).select("id", "company_slug", F.col("id").alias("ordinal"))
    current = base.where("id % 3 <> 0").withColumn("store", F.lit("current"))
    first = base.where("id % 2 = 0").withColumn("store", F.lit("first"))
    second = base.withColumn("store", F.lit("second"))
    # The second store holds every post twice.
    twice = second.unionByName(second.withColumn("ordinal", F.col("ordinal") + 1000000000))
    return fm.merge_stores([current, first, twice]).select("id", "company_slug", "store")


@query(
    "u2_state_overlay",
    q.with_ctes(
        ["job_state_events"],
        """SELECT seq, concat('saved=', CASE WHEN action = 'save' THEN job_id ELSE 'none' END, '|sort=', CASE WHEN seq % 2 = 0 THEN 'pay' ELSE 'fresh' END,
        CASE WHEN seq % 3 = 0 THEN concat('|user=', user_uid) ELSE '' END) AS settings FROM job_state_events""",
    ),
)
def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(key: str, value):
        return F.create_map(F.lit(key), value)

    rows = view(spark, sf_dir, "job_state_events").select(
        "seq",
        F.create_map(F.lit("saved"), F.lit("none"), F.lit("sort"), F.lit("fresh")).alias("defaults"),
        F.when(F.col("action") == "save", one("saved", F.col("job_id"))).alias("stored"),
        F.map_concat(
            F.when(F.col("seq") % 2 == 0, one("sort", F.lit("pay"))).otherwise(F.create_map().cast("map<string,string>")),
            F.when(F.col("seq") % 3 == 0, one("user", F.col("user_uid"))).otherwise(F.create_map().cast("map<string,string>")),
        ).alias("patch"),
    )
    made = st.overlay(rows, ["defaults", "stored", "patch"], "settings")
    pairs = F.transform(F.array_sort(F.map_entries("settings")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return made.select("seq", F.array_join(pairs, "|").alias("settings"))


@query(
    "l4_company_page",
    q.with_ctes(
        ["posts", "comments", "vote_events", "companies", "domain_overrides"],
        """SELECT s.id, s.company_slug, s.created_ms, s.score, greatest(s.comment_count, coalesce(c.n, 0)) AS comment_count,
        coalesce(v.value, 0) AS my_vote, coalesce(r.name, replace(s.company_slug, '-', ' ')) AS company_name,
        coalesce(r.industry, 'Company') AS company_industry,
        s.score + greatest(s.comment_count, coalesce(c.n, 0)) * 2 + s.created_ms / 1e13 AS hot_score
        FROM shown s LEFT JOIN (SELECT post_id, count(*) AS n FROM loaded GROUP BY post_id) c ON c.post_id = s.id
        LEFT JOIN vote_state v ON v.target_id = s.id AND v.target_type = 'post' AND v.user_uid = 'u7'
        LEFT JOIN registry r ON r.slug = s.company_slug WHERE s.company_slug = 'c3'""",
        _LOADED, _EVENTS_ONLY, _ISLANDS, _REGISTRY,
    ),
)
def company_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = posts(spark, sf_dir).select("id", "company_slug", "created_ms", "score", "comment_count", "status")
    state = vo.vote_state(votes(spark, sf_dir))
    return fm.company_page(rows, comments(spark, sf_dir), state, registry(spark, sf_dir), "c3", "u7").drop("status")
