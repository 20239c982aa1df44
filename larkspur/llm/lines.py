"""Removal of repeated runs of lines by suffix ranks over line-id sequences.

A document is the sequence of its lines that are not blank, each by its id. Suffixes are ranked by prefix doubling: the
name of a suffix at depth 2k is made of the names at depth k here and k lines on. Suffixes of one name are an interval of
the suffix array with a longest common prefix of that depth at least; names that only one suffix has are left out of
later rounds. Depths grow until no name is shared. In every interval all suffixes but the first, in document order, are
later copies, each of as many lines as its deepest interval tells. A run counts from two lines on, and one line alone from
LONG_WORDS words on. The union of a document's later copies are its repeated
runs, and their lines are deleted. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.components import free_names
from larkspur.session import stored

LEAST_LINES = 2
LONG_WORDS = 50
WORD = r"[^\x20\x09-\x0D]"


def line_array(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def is_long(line: Column) -> Column:
    """Whether a line has LONG_WORDS words; lines too short for that are not split."""
    words = F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(F.octet_length(line) >= 2 * LONG_WORDS - 1, F.size(words) >= LONG_WORDS).otherwise(False)


def full_lines(text: Column) -> Column:
    """Place and id of each line that is not blank, and whether it is long."""
    named = F.transform(
        line_array(text), lambda line, i: F.struct(i.alias("line"), F.when(line.rlike(WORD), F.xxhash64(line)).alias("name"), is_long(line).alias("long"))
    )
    return F.filter(named, lambda x: x["name"].isNotNull())


def shared(named: DataFrame, *more: str) -> DataFrame:
    """Rows whose name several suffixes have, with ``later``: whether it is not the first of them."""
    place = F.struct("doc", "tie", "pos")
    intervals = named.groupBy("name").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    return named.join(intervals, "name").select(
        "doc", "tie", "pos", "line", "end", "name", (place > F.col("first")).alias("later"), *more
    )


def deepened(ranked: DataFrame, ahead: int) -> DataFrame:
    """Suffixes named by their name and that of the suffix ``ahead`` lines on, if that is shared too."""
    on = ranked.select("doc", "tie", (F.col("pos") - ahead).alias("pos"), F.col("name").alias("next"), F.col("end").alias("_end"))
    named = F.xxhash64("name", "next").alias("name")
    return ranked.join(on, ["doc", "tie", "pos"]).select("doc", "tie", "pos", "line", F.col("_end").alias("end"), named)


def suffix_intervals(docs: DataFrame, least: int) -> DataFrame:
    """Later copies (doc, tie, pos, depth, line, end): suffixes whose first ``depth`` lines, ``least`` or more or one long line,
    also start earlier; they reach from ``line`` to ``end`` in the text."""
    sequence = docs.select("doc", "tie", F.posexplode(full_lines(F.col("text"))).alias("pos", "x"))
    ranked = stored(shared(sequence.select("doc", "tie", "pos", "x.line", F.col("x.line").alias("end"), "x.name", "x.long"), "long"), "ranks")
    depth, copies = 1, []
    while True:
        if depth >= least or depth == 1:
            copies.append(ranked.where("later" if depth >= least else "later AND long").select("doc", "tie", "pos", F.lit(depth).alias("depth"), "line", "end"))
        ahead = depth if depth >= least else min(depth, least - depth)
        ranked = stored(shared(deepened(ranked, ahead)), "ranks")
        depth += ahead
        if ranked.isEmpty():
            break
    found = copies[0]
    for more in copies[1:]:
        found = found.unionByName(more)
    return found.groupBy("doc", "tie", "pos").agg(F.max("depth").alias("depth"), F.min("line").alias("line"), F.max("end").alias("end"))


def repeated_runs(docs: DataFrame, least: int) -> DataFrame:
    """Per document the maximal runs of repeated lines: first and last line of the text, and how many of them are not blank."""
    by_place = Window.partitionBy("doc", "tie").orderBy("pos")
    reached = F.max(F.col("pos") + F.col("depth")).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    opened = suffix_intervals(docs, least).withColumn("opens", (F.col("pos") > F.coalesce(reached, F.lit(-1))).cast("int"))
    numbered = opened.withColumn("run", F.sum("opens").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("doc", "tie", "run").agg(
        F.min("line").alias("first"), F.max("end").alias("last"), (F.max(F.col("pos") + F.col("depth")) - F.min("pos")).alias("full")
    )
    return runs.groupBy(F.col("doc").alias("_doc"), F.col("tie").alias("_tie")).agg(
        F.collect_list(F.struct("first", "last")).alias("_runs"), F.sum("full").alias("_full")
    )  # a document's runs are fewer than its lines


def judge_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LINES, into: str = "lines") -> DataFrame:
    """Every row of ``docs`` with a struct ``into``: n_lines (not blank), n_removed, n_runs, and ``kept``, the text left.

    A run has ``least`` lines at least, or is one line of LONG_WORDS words or more. Adjacent repeated runs are one run. A run is
    deleted with the blank lines inside it; other blank lines stay. Lines are judged on the input, by their whole text; the first copy in
    order of doc_id and place stays. Null texts are empty. Null ids come first; rows of one doc_id come in order of a
    fingerprint of their text, and rows alike in both are one document with one result. A very long text is exploded to a row per
    line like any other. A column ``into`` is replaced, other columns stay as they are; an empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    runs = repeated_runs(docs.select(key.alias("doc"), F.xxhash64(body).alias("tie"), body.alias("text")), least)
    of_doc, of_tie, held, full = free_names([*docs.columns, into], "_doc", "_tie", "_runs", "_full")
    joined = docs.join(runs.toDF(of_doc, of_tie, held, full), (key == F.col(of_doc)) & (F.xxhash64(body) == F.col(of_tie)), "left")
    every = line_array(F.col(text))
    kept = F.filter(every, lambda _, i: ~F.exists(F.col(held), lambda r: i.between(r["first"], r["last"])))
    made = F.struct(
        F.size(F.filter(every, lambda line: line.rlike(WORD))).cast("long").alias("n_lines"),
        F.coalesce(full, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_size(held), F.lit(0)).cast("long").alias("n_runs"),
        F.when(F.col(held).isNull(), body).otherwise(F.array_join(kept, "\n")).alias("kept"),
    )
    return joined.select(*[c for c in docs.columns if c != into], made.alias(into))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents without repeated line runs, with their columns; ``n_chars`` follows the text. Documents that had lines and
    lose them all go, others stay."""
    (into,) = free_names(docs.columns, "_lines")
    lines = F.col(into)
    judged = judge_lines(docs, into=into).where((lines["n_lines"] == 0) | (lines["n_removed"] < lines["n_lines"]))
    changed = lines["n_removed"] > 0
    text = F.when(changed, lines["kept"]).otherwise(F.col("text")).alias("text")
    chars = F.when(changed, F.char_length(lines["kept"]).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return judged.select([{"text": text, "n_chars": chars}.get(c, F.col(c)) for c in docs.columns])
