"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from larkspur.llm import chat, codes, jaccard, lines, maxscore, mixing, pages, periods, personal, pieces, quality, sentences, suffix

AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 1 chat formatting

SAYING = "</s>[INST] ok [/INST]"
DUCK_CONTROLS = r"</?s>|\[/?INST\]|<</?SYS>>|<\|(?:text|image|audio|document)\|>"


@query(
    "op1_chat_format",
    rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{SAYING}'), (-7, 1, 'assistant', '{SAYING}')
), shown AS (
  SELECT *, length(role) + length(text) + len(regexp_extract_all(role, '{DUCK_CONTROLS}')) + len(regexp_extract_all(text, '{DUCK_CONTROLS}'))
    + (length(role) - length(replace(role, '\', ''))) + (length(text) - length(replace(text, '\', '')))
    + CASE WHEN role = 'assistant' THEN length('<s><|text|></s>') ELSE length('[INST]<|text|>[/INST]') END AS chars
  FROM said
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id""",
)
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAYING).alias("text"),
    )
    formatted = chat.format_chats(chat.text_parts(said.unionByName(more)))
    read = formatted.withColumns(
        {"turns": chat.read_back(F.col("formatted")), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))}
    )
    said_again = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said_again, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


# --- 5 HTML extraction


@query("op5_html_text")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    extracted = pages.extract_pages(table(spark, sf_dir, "pages"))
    return extracted.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


# --- 6 exact top-k search


@query(
    "op6_top_k",
    """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row AS query, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
)
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.finite_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return maxscore.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


# --- 7 quality rules


@query("op7_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", "quality.*")


# --- 10 SentencePiece encoding and decoding

MODEL = "piece_bpe_32k.model"


@query("op10_pieces")
def encode_pieces(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    made = pieces.encode_documents(docs, public_tokenizers.path(MODEL), keep=["doc_id"])
    return made.select(
        "doc_id",
        F.expr("octet_length(pieces.ids) div 4").alias("n_tokens"),
        F.sha2("pieces.ids", 256).alias("ids_sha256"),
        F.sha2("pieces.decoded", 256).alias("decoded_sha256"),
    )


# --- 2 n-gram Jaccard join


@query(
    "op2_jaccard_join",
    rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{AZ}', '{AZ.lower()}'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams
  FROM w
), g AS MATERIALIZED (
  SELECT doc_id, len(grams) AS n, hash(unnest(grams)) AS gram FROM s
), link AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(doc_id, other) AS (
  SELECT a, b FROM link UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other
)
SELECT doc_id, CAST(len(grams) AS BIGINT) AS n_shingles,
  least(doc_id, coalesce((SELECT min(other) FROM reach r WHERE r.doc_id = s.doc_id), doc_id)) AS component_id
FROM s""",
)
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(table(spark, sf_dir, "documents"))


# --- 4 suffix-array dedup


@query("op4_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# --- 3 line dedup


@query(
    "op3_line_dedup",
    r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), seq AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), two AS (
  SELECT doc_id, pos, i, line, lead(line) OVER w AS next, lead(i) OVER w AS next_i FROM seq WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, pos) AS nth FROM two WHERE next IS NOT NULL
  ) WHERE nth > 1
), later_long AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS nth FROM seq
    WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50
  ) WHERE nth > 1
), taken AS (
  SELECT doc_id, pos, i, next_i, lead(pos) OVER w = pos + 1 AS goes_on, lag(pos) OVER w AS before FROM two
  WHERE (doc_id, pos) IN (SELECT doc_id, pos + k FROM later, (VALUES (0), (1)) AS t(k) UNION ALL FROM later_long) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), gone AS (
  -- A removed line takes the blank ones between it and a removed line that follows.
  SELECT l.doc_id, l.i FROM line l JOIN taken t ON t.doc_id = l.doc_id AND l.i >= t.i AND l.i < CASE WHEN t.goes_on THEN t.next_i ELSE t.i + 1 END
), run AS (
  SELECT doc_id, count(*) AS n_runs FROM taken WHERE before IS NULL OR pos > before + 1 GROUP BY doc_id
), whole AS (
  SELECT l.doc_id, count(s.pos) AS n_lines, count(s.pos) FILTER (g.i IS NOT NULL) AS n_removed,
    sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '')) AS kept_sha256
  FROM line l LEFT JOIN seq s ON s.doc_id = l.doc_id AND s.i = l.i LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
)
SELECT doc_id, n_lines, n_removed, coalesce(n_runs, 0) AS n_runs, kept_sha256 FROM whole LEFT JOIN run USING (doc_id)""",
)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = lines.judge_lines(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "lines.n_lines", "lines.n_removed", "lines.n_runs", F.sha2("lines.kept", 256).alias("kept_sha256"))


# --- 8 substring dedup by sentence spans


@query(
    "op8_sentence_dedup",
    rf"""
WITH piece AS (
  SELECT doc_id, regexp_extract(coalesce(text, ''), '^[\x20\x09-\x0D]*') AS lead,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS pieces FROM documents
), word AS (
  SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM piece
), cut AS (
  SELECT *, regexp_extract(piece, '^[^\x20\x09-\x0D]+') AS word, lag(piece) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM word
), numbered AS (
  SELECT *, sum(CASE WHEN before IS NULL OR contains(before, chr(10)) OR regexp_matches(before, '(?:[.!?]|。|！|？)[\x20\x09-\x0D]*$') THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY i) AS n FROM cut
), sentence AS MATERIALIZED (
  SELECT doc_id, n, count(*) AS n_words, string_agg(piece, '' ORDER BY i) AS shown,
    translate(string_agg(word, ' ' ORDER BY i), '{AZ}', '{AZ.lower()}') AS said
  FROM numbered GROUP BY doc_id, n
), run AS (
  SELECT doc_id, n, 1 AS size, said AS a, NULL AS b FROM sentence WHERE n_words >= {sentences.LONG_WORDS}
  UNION ALL SELECT * FROM (SELECT doc_id, n, 2, said, lead(said) OVER (PARTITION BY doc_id ORDER BY n) AS next FROM sentence) WHERE next IS NOT NULL
), later AS (
  SELECT doc_id, n, size FROM (SELECT *, row_number() OVER (PARTITION BY size, a, b ORDER BY doc_id, n) AS nth FROM run) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, n + k AS n FROM later, (VALUES (0), (1)) AS t(k) WHERE k < size
), judged AS (
  SELECT s.*, g.n IS NOT NULL AS gone, lag(g.n) OVER (PARTITION BY s.doc_id ORDER BY s.n) IS NOT NULL AS after_gone
  FROM sentence s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.n = s.n
), summed AS (
  SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT after_gone) AS n_runs,
    string_agg(shown, '' ORDER BY n) FILTER (NOT gone) AS kept FROM judged GROUP BY doc_id
)
SELECT doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
  sha256(lead || coalesce(kept, '')) AS kept_sha256
FROM piece LEFT JOIN summed USING (doc_id)""",
)
def sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = sentences.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_sentences", "n_removed", "n_runs", F.sha2("kept", 256).alias("kept_sha256"))


# --- 9 mixing sources to target weights


def level_sql(name: str, keys: list[str], weight: str, given: str) -> str:
    """One level of the tree: fill nodes in order of room per weight, and share the rest by weight."""
    parent = ", ".join(keys[:-1]) or "1"
    order = ", ".join([f"{k} NULLS FIRST" for k in keys])
    return f"""
{name}_node AS (
  SELECT n.*, {given} AS given FROM (
    SELECT {", ".join(keys)}, CAST(sum(tokens) * {mixing.MOST_EPOCHS} AS DOUBLE) AS room, CAST({weight} AS DOUBLE) AS weight FROM leaf GROUP BY ALL
  ) n
), {name}_level AS (
  SELECT *, row_number() OVER w AS nth,
    (given - coalesce(sum(room) OVER (PARTITION BY {parent} ORDER BY room / weight, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (PARTITION BY {parent} ORDER BY room / weight, {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM {name}_node WINDOW w AS (PARTITION BY {parent} ORDER BY room / weight, {order})
), {name}_held AS (
  SELECT *, min(CASE WHEN level * weight < room THEN nth END) OVER (PARTITION BY {parent}) AS held,
    arg_min(level, nth) FILTER (level * weight < room) OVER (PARTITION BY {parent}) AS share
  FROM {name}_level
), {name} AS (
  SELECT {", ".join(keys)}, CASE WHEN held IS NULL OR nth < held THEN room ELSE greatest(share, 0) * weight END AS budget FROM {name}_held
)"""


def case_sql(column: str, weights: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def parent_sql(parent: str, keys: list[str]) -> str:
    return f"(SELECT p.budget FROM {parent} p WHERE " + " AND ".join(f"p.{k} IS NOT DISTINCT FROM n.{k}" for k in keys) + ")"


MIX_SQL = f"""
WITH row AS (
  SELECT doc_id, CASE WHEN coalesce(source, '') LIKE '%0' THEN 'hub' ELSE 'edge' END AS domain, lang, source,
    CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT) AS n_tokens FROM documents
), leaf AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM row GROUP BY ALL
), {level_sql("d", ["domain"], case_sql("domain", mixing.DOMAIN_WEIGHTS), f"(SELECT sum(tokens) * CAST({mixing.SHARE} AS DOUBLE) FROM leaf)")},
{level_sql("l", ["domain", "lang"], case_sql("lang", mixing.LANGUAGE_WEIGHTS), parent_sql("d", ["domain"]))},
{level_sql("s", ["domain", "lang", "source"], "1", parent_sql("l", ["domain", "lang"]))},
spent AS (
  SELECT leaf.*, CAST(floor(s.budget + 1e-6) AS BIGINT) AS budget FROM leaf JOIN s
    ON s.domain = leaf.domain AND s.lang IS NOT DISTINCT FROM leaf.lang AND s.source IS NOT DISTINCT FROM leaf.source
), placed AS (
  SELECT row.*, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE -1 END AS rest
  FROM row JOIN spent
    ON spent.domain = row.domain AND spent.lang IS NOT DISTINCT FROM row.lang AND spent.source IS NOT DISTINCT FROM row.source
), summed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY substr(md5('{mixing.SEED}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8), doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM placed
)
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS n_copies FROM summed"""


@query("op9_mix", MIX_SQL)
def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("tie")


# --- 11 personal data


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op11_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("personal", lambda s: s["base"])
    kinds = F.transform("base", lambda s: s["kind"])
    of_kind = {f"n_{k}": (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long") for k in personal.KINDS}
    return found.withColumn("base", base).select(
        "doc_id", *[n.alias(name) for name, n in of_kind.items()],
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("personal")).alias("spans"),
    )


# --- 12 periodic runs of words


@F.arrow_udf(StringType())
def with_tail(texts: pa.Array, hashes: pa.Array) -> pa.Array:
    """Each text with its words from one place on repeated with one period, both drawn from the row's hash; null stays."""
    made = []
    for text, h in zip(texts, hashes):
        words, g = (text.as_py() or "").encode().split(), (h.as_py() or 0) // 10
        if words:
            at = g % len(words)
            period = 1 + (len(words) - at) // (3 + g % 8)
            words[at:] = [words[at + k % period] for k in range(len(words) - at)]
        made.append(b" ".join(words).decode() if text.is_valid else None)
    return pa.array(made, pa.string())


@query("op12_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"), F.coalesce(h % 10 == 0, F.lit(False)).alias("dealt"))
    tailed = with_tail(F.when(F.col("dealt"), F.col("text")), F.col("h"))
    docs = docs.withColumn("tailed", tailed).select("doc_id", F.when(F.col("dealt"), F.col("tailed")).otherwise(F.col("text")).alias("text"))
    found = periods.find_runs(docs, keep=["doc_id"]).select("doc_id", "periods.*").withColumn("best", periods.strongest("runs"))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# --- 13 vector code compression


def round_sql(k: int) -> str:
    """One round: the nearest entries of all parts, then the floors of the means."""
    return f"""
near{k} AS MATERIALIZED (
  SELECT row_id, p, CAST(min(d * {codes.ENTRIES} + e) AS BIGINT) AS k FROM (
    SELECT row_id, p, e, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM part JOIN book{k} USING (p, j) GROUP BY ALL
  ) GROUP BY ALL
), book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, b.j, coalesce(m.y, b.y) AS y FROM book{k} b LEFT JOIN (
    SELECT p, k % {codes.ENTRIES} AS e, j, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS y
    FROM part JOIN near{k} USING (row_id, p) GROUP BY ALL
  ) m ON m.p = b.p AND m.e = b.e AND m.j = b.j
), """


CODES_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row_id FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS MATERIALIZED (
  SELECT row_id, (i - 1) // w AS p, (i - 1) % w AS j, CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM (
    SELECT row_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i, len(embedding) // {codes.PARTS} AS w FROM v
  )
), book0 AS (
  SELECT p, row_id - 1 AS e, j, x AS y FROM part WHERE row_id <= {codes.ENTRIES}
), {"".join(round_sql(k) for k in range(codes.ROUNDS + 1))}coded AS (
  SELECT row_id, string_agg(printf('%02x', k % {codes.ENTRIES}), '' ORDER BY p) AS code, CAST(sum(k // {codes.ENTRIES}) AS BIGINT) AS error
  FROM near{codes.ROUNDS} GROUP BY row_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, j)) FROM book{codes.ROUNDS}) AS codebooks_sha256
FROM coded JOIN v USING (row_id)"""


@query("op13_vector_codes", CODES_SQL)
def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings")).drop("label")
