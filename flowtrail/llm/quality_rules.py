"""Quality rules: counts per text, and lines that many documents of a host share.

Only DataFrame expressions are used. Counts are made inside each row; no window of words
leaves its document. Of lines, only 64-bit hashes and word counts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtrail.llm.common import BLANK, WORD
from flowtrail.session import stage

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
# A line is boilerplate of a host in more than this share of its documents, and in more than so many of them.
LINE_PERCENT, LEAST_DOCS = 5, 5
# Up to so many boilerplate lines are sent to all tasks (8 bytes each); more meet the lines in a shuffle.
MOST_SENT = 500_000
# A document that loses more than this share of its words to such lines is rejected.
MAX_LOST_PERCENT = 70
SYMBOLS = r"[^#*$%&|<>]+"


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, white space as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), BLANK, " "))


def line_key(host: Column, line: Column) -> Column:
    return F.xxhash64(host, normal_line(line))


def measured(docs: DataFrame, host: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id"), F.coalesce(F.col(host), F.lit("")).alias("host"), text.alias("text"))
    words = base.select(
        "doc_id",
        F.xxhash64("host").alias("host"),
        F.xxhash64("host", "text").alias("text_key"),
        F.hash("text").alias("text_key2"),
        F.length(F.regexp_replace("text", BLANK, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.sha2("text", 256).alias("text_sha256"),
        F.col("host").alias("host_name"),
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
    )
    hashed = words.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.expr(
            f"case when size(words) >= {WINDOW} then transform(sequence(0, size(words) - {WINDOW}), "
            f"i -> xxhash64({', '.join(f'words[i + {k}]' for k in range(WINDOW))})) end"
        ).alias("windows"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(
            "lines",
            lambda x: F.struct(line_key(F.col("host_name"), x).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n")),
        ).alias("line_words"),
    ).drop("words", "lines", "host_name")
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = hashed.withColumn(
        "placed",
        F.when(repeats, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))),
    ).drop("windows")
    found = F.expr(
        "array_sort(transform(filter(transform(placed, (e, j) -> struct(e.i as i, "
        "get(placed, j - 1).h <=> e.h or get(placed, j + 1).h <=> e.h as twice)), x -> x.twice), x -> x.i))"
    )
    placed = placed.withColumn("found", found).drop("placed")
    covered = F.expr(
        f"aggregate(found, named_struct('n', 0L, 'last', -{WINDOW}), "
        f"(a, i) -> named_struct('n', a.n + least({WINDOW}, i - a.last), 'last', i), a -> a.n)"
    )
    return placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("found")


def keyed(host: str) -> tuple[Column, Column]:
    """Two hashes that tell the texts of all hosts apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.xxhash64(F.coalesce(F.col(host), F.lit("")), text).alias("text_key"), F.hash(text).alias("text_key2")


def counted_rows(docs: DataFrame, host: str) -> DataFrame:
    """The measures of every row, with a number of its own, written once."""
    return stage(measured(docs, host).withColumn("row", F.monotonically_increasing_id()), "quality_rows")


def losses(rows: DataFrame, line_percent: int, least_docs: int) -> DataFrame:
    """Rows with over-limit lines: row, keys of their text, lines and words lost, hashes of those lines.

    A row counts a line of its host once, and every row is a document. Counts are added up
    where the rows lie, so a line that is in all of them does not burden one task.
    """
    lines = rows.select("host", F.explode(F.array_distinct("line_words.line")).alias("line"))
    lines = lines.groupBy("line").agg(F.any_value("host").alias("host"), F.count("*").alias("docs")).where(F.col("docs") > least_docs)
    hosts = rows.groupBy("host").agg(F.count("*").alias("all_docs"))
    common = lines.join(hosts, "host").where(100 * F.col("docs") > line_percent * F.col("all_docs")).select("line")
    common = stage(common, "boilerplate")
    few = F.broadcast(common) if common.count() <= MOST_SENT else common
    return (
        rows.select("row", "text_key", "text_key2", F.inline("line_words"))
        .join(few, "line")
        .groupBy("row")
        .agg(
            F.any_value("text_key").alias("text_key"), F.any_value("text_key2").alias("text_key2"), F.sum("n").alias("lost"),
            F.count("*").alias("lost_lines"), F.collect_set("line").alias("gone"),
        )
    )


def without(text: Column, host: Column, gone: Column) -> Column:
    """The text without the lines whose hashes are in ``gone``; blank lines stay."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(WORD) | ~F.array_contains(gone, line_key(host, x))), "\n")


def failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def depleted(max_lost_percent: int) -> Column:
    return F.coalesce(100 * F.col("lost") > max_lost_percent * F.col("n_words"), F.lit(False))


def quality(
    docs: DataFrame,
    host: str = "source",
    line_percent: int = LINE_PERCENT,
    least_docs: int = LEAST_DOCS,
    max_lost_percent: int = MAX_LOST_PERCENT,
) -> DataFrame:
    """Counts and verdict for every row of ``docs`` (doc_id, text, ``host``).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_lost_lines and n_lost_words (in lines that more than ``line_percent``
    percent and more than ``least_docs`` of the host's documents hold), cleaned_sha256 (of the
    text without these lines). Lines are compared in normal form. A document is not kept if it
    fails the base rules or loses more than ``max_lost_percent`` percent of its words.

    Every row is a document, so repeated rows and exact copies count each. A null text counts
    as empty: no words, so it fails. A null host is the empty host. Null ids keep their rows.
    An empty table gives no rows. Other columns are left out, whatever they are called. Lines,
    windows and texts are told apart by 64-bit hashes (texts by 96 bits).
    """
    rows = counted_rows(docs, host)
    lost = stage(losses(rows, line_percent, least_docs), "lost_lines")
    texts = lost.select("text_key", "text_key2", "gone").dropDuplicates(["text_key", "text_key2"])
    key, key2 = keyed(host)
    found = docs.select(key, key2, F.coalesce(F.col(host), F.lit("")).alias("own"), F.col("text")).join(texts, ["text_key", "text_key2"])
    digests = found.dropDuplicates(["text_key", "text_key2"]).select(
        "text_key", "text_key2", F.sha2(without(F.col("text"), F.col("own"), F.col("gone")), 256).alias("left_sha256")
    )
    lost = lost.drop("gone").join(digests, ["text_key", "text_key2"], "left").drop("text_key", "text_key2")
    return rows.drop("line_words", "host", "text_key", "text_key2").join(lost, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed().alias("base_failed"),
        (~failed() & ~depleted(max_lost_percent)).alias("kept"),
        F.coalesce("lost_lines", F.lit(0)).alias("n_lost_lines"),
        F.coalesce("lost", F.lit(0)).cast("long").alias("n_lost_words"),
        F.coalesce("left_sha256", "text_sha256").alias("cleaned_sha256"),
    )


def cleaned(
    docs: DataFrame,
    host: str = "source",
    line_percent: int = LINE_PERCENT,
    least_docs: int = LEAST_DOCS,
    max_lost_percent: int = MAX_LOST_PERCENT,
) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, all columns, over-limit lines taken out of ``text``.

    What stays of a text stays as it was and in its order; blank lines stay. Other columns,
    also those that count the text, are not changed, and may have any name. Null, empty and
    blank texts have no words and go. Repeated rows and null ids are rows of their own; an empty
    table gives none. The text is cut where it lies: only hashes of lines meet it, those of
    its own over-limit lines.
    """
    rows = counted_rows(docs, host)
    lost = losses(rows, line_percent, least_docs).select("row", "lost", "gone")
    verdicts = (
        rows.where(~failed()).select("row", "n_words", "text_key", "text_key2").join(lost, "row", "left")
        .where(~depleted(max_lost_percent)).dropDuplicates(["text_key", "text_key2"])
    )
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = dict(zip(docs.columns, names))
    key, key2 = keyed("host")
    plain = docs.toDF(*names).withColumnsRenamed({place["text"]: "text", place[host]: "host"})
    found = plain.withColumns({"text_key": key, "text_key2": key2})
    found = found.join(verdicts.select("text_key", "text_key2", "gone"), ["text_key", "text_key2"])
    cut = without(F.col("text"), F.coalesce(F.col("host"), F.lit("")), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(cut)
    now = {place["text"]: text, place[host]: F.col("host")}
    return found.select(*[now.get(n, F.col(n)).alias(c) for n, c in zip(names, docs.columns)])
