"""Version-control logs as text: three formats to rows of commits.

The formats are ``hash|epoch|author|subject``, the default one (``commit``, ``Author:``, ``Date:``, indented subject) and
one line per commit. Lines of changed files belong to the commit above them. In a text of one row, commits are runs of its
lines. In logs as lines a commit is numbered by counting headers above its lines: within a split of the log by a window, and over splits by sums of their headers. So lines before a split's
first header go to the last commit of the splits above, and a log of any size is read without a row, a window or a task that
holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import once

# Shapes of lines.
PIPED = r"(?i)^\s*([0-9a-f]{6,40})\|(\d{6,})\|([^|]*)\|(.*)$"
HEADER = r"(?i)^commit\s+([0-9a-f]{7,40})"
ONELINE = r"(?i)^\s*([0-9a-f]{7,40})\s+(\S.*)$"
AUTHOR, DATE, SUBJECT = r"^Author:\s*(.+?)\s*<", r"^Date:\s*(.+)$", r"^\s{4}(\S.*)$"
NUMSTAT = r"^\s*(\d+|-)\t(\d+|-)\t(.+)$"
CHANGED, INSERTED, DELETED = r"(\d+) files? changed", r"(\d+) insertions?\(\+\)", r"(\d+) deletions?\(-\)"


def _number(text, pattern, group):
    found = F.regexp_extract(text, pattern, group)
    return F.coalesce(F.when(found.rlike(r"^\d{1,18}$"), found).cast("long"), F.lit(0))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(log, split, at, line) of log files: Spark reads a large file in splits, and the name of the file stands for its repository."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("log"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))
    return rows.select("log", "split", F.monotonically_increasing_id().alias("at"), F.regexp_replace("line", "\r$", "").alias("line"))


def _kind(line: Column) -> Column:
    """What a line is; null if it says nothing of a commit."""
    piped, numstat = line.rlike(PIPED), line.rlike(NUMSTAT)
    header = ~piped & line.rlike(HEADER)
    oneline = ~piped & ~numstat & ~header & line.rlike(ONELINE) & ~line.rlike(r"(?i)^(?:commit|Author|Date|Merge)\b")
    return F.when(piped, "piped").when(numstat, "numstat").when(line.rlike(CHANGED), "short").when(header, "header").when(line.rlike(AUTHOR), "author").when(line.rlike(DATE), "date").when(line.rlike(SUBJECT), "subject").when(oneline, "oneline")


def _starts(kind: Column) -> Column:
    return kind.isin("piped", "header", "oneline")


def _hash(kind: Column, line: Column) -> Column:
    return F.when(kind == "piped", F.regexp_extract(line, PIPED, 1)).when(kind == "header", F.regexp_extract(line, HEADER, 1)).when(kind == "oneline", F.regexp_extract(line, ONELINE, 1))


def _time(kind: Column, line: Column) -> Column:
    stamp = F.try_to_timestamp(F.regexp_extract(line, r"^Date:\s*\w{3}\s+(.+)$", 1), F.lit("MMM d HH:mm:ss yyyy Z"))
    return F.when(kind == "piped", _number(line, PIPED, 2)).when(kind == "date", F.unix_seconds(stamp))


def _subject(kind: Column, line: Column) -> Column:
    return F.when(kind == "piped", F.trim(F.regexp_extract(line, PIPED, 4))).when(kind == "oneline", F.trim(F.regexp_extract(line, ONELINE, 2)))


def _lines_changed(kind: Column, line: Column, group: int, pattern: str) -> Column:
    return F.when(kind == "numstat", _number(line, NUMSTAT, group)).when(kind == "short", _number(line, pattern, 1)).otherwise(0)


def commits(logs: DataFrame, id_col: str = "repo_id", log_col: str = "log") -> DataFrame:
    """(repo_id, hash, ts, author, subject, added, removed, files, paste_pos) of each commit in a repository's log, a text in one row.

    Unknown times are 0. A binary file counts as a file without lines. Files below a one-line commit belong to none. As the
    text is in one row, its commits are found in that row: nothing is shuffled, and a task holds one text at a time.
    """
    text = F.regexp_replace(F.coalesce(F.col(log_col), F.lit("")), r"\r\n?", "\n")
    told = F.filter(F.transform(F.split(text, "\n"), lambda x: F.struct(_kind(x).alias("kind"), x.alias("line"))), lambda r: r["kind"].isNotNull())
    heads = lambda lines: F.filter(F.transform(lines, lambda r, i: F.when(_starts(r["kind"]), i + 1)), lambda i: i.isNotNull())
    parts = once(told, lambda lines: once(heads(lines), lambda at: F.transform(at, lambda first, k: F.slice(lines, first, F.coalesce(F.get(at, k + 1), F.size(lines) + 1) - first))))
    rows = logs.select(id_col, F.posexplode(parts).alias("_k", "_lines"))
    part, head = F.col("_lines"), F.col("_lines")[0]
    of = lambda kind, value: F.transform(F.filter(part, lambda r: r["kind"] == kind), lambda r: value(r["line"]))
    total = lambda group, pattern: F.aggregate(part, F.lit(0).cast("long"), lambda n, r: n + _lines_changed(r["kind"], r["line"], group, pattern))
    files = F.greatest(F.size(F.filter(part, lambda r: r["kind"] == "numstat")).cast("long"), F.coalesce(F.array_max(of("short", lambda x: _number(x, CHANGED, 1))), F.lit(0)))
    counted = {"added": total(1, INSERTED), "removed": total(2, DELETED), "files": files}
    return rows.select(
        id_col, F.lower(_hash(head["kind"], head["line"])).alias("hash"), F.coalesce(F.array_max(F.transform(part, lambda r: _time(r["kind"], r["line"]))), F.lit(0)).alias("ts"),
        F.coalesce(F.when(head["kind"] == "piped", F.trim(F.regexp_extract(head["line"], PIPED, 3))), F.get(of("author", lambda x: F.regexp_extract(x, AUTHOR, 1)), F.lit(0)), F.lit("")).alias("author"),
        F.coalesce(_subject(head["kind"], head["line"]), F.get(of("subject", lambda x: F.regexp_extract(x, SUBJECT, 1)), F.lit(0)), F.lit("")).alias("subject"),
        *[F.when(head["kind"] == "oneline", F.lit(0)).otherwise(n).cast("long").alias(c) for c, n in counted.items()], (F.col("_k") + 1).cast("long").alias("paste_pos"),
    )


def commits_of_lines(rows: DataFrame, id_col: str = "log", tasks: int | None = None) -> DataFrame:
    """commits() of logs as lines (log, split, at, line): split orders the parts of a log, at the lines of a part.

    With ``tasks``, whose number should grow with the lines, they are dealt to so many tasks, so that the memory of one stays
    the same however many lines there are.
    """
    line, kind = F.col("line"), F.col("kind")
    marked = rows.withColumn("kind", _kind(line)).filter("kind is not null")
    dealt = lambda df, *keys: df.repartition(tasks, *keys) if tasks else df
    marked = dealt(marked, id_col, "split")
    above = Window.partitionBy(id_col).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    before = marked.groupBy(id_col, "split").agg(F.count_if(_starts(kind)).alias("_n")).select(id_col, "split", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(id_col, "split").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("_inside", F.count_if(_starts(kind)).over(inside))
    first = lambda k, v: F.min_by(v, F.when(kind == k, F.col("at")))
    # lines become parts of commits where they are; only these go to the other splits of their commits
    parts = marked.groupBy(id_col, "split", "_inside").agg(
        F.max(_hash(kind, line)).alias("_hash"), F.max(_time(kind, line)).alias("_ts"), F.max(F.when(kind == "piped", F.trim(F.regexp_extract(line, PIPED, 3)))).alias("_piped"), first("author", F.regexp_extract(line, AUTHOR, 1)).alias("_author"),
        F.max(_subject(kind, line)).alias("_said"), first("subject", F.regexp_extract(line, SUBJECT, 1)).alias("_subject"), F.max(kind == "oneline").alias("_one"),
        F.sum(_lines_changed(kind, line, 1, INSERTED)).alias("_added"), F.sum(_lines_changed(kind, line, 2, DELETED)).alias("_removed"), F.count_if(kind == "numstat").alias("_stats"), F.max(F.when(kind == "short", _number(line, CHANGED, 1))).alias("_short"),
    )
    parts = parts.join(before, [id_col, "split"]).withColumn("no", F.col("_before") + F.col("_inside")).filter("no > 0")
    earliest = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("split")))
    return dealt(parts, id_col, "no").groupBy(id_col, "no").agg(
        F.lower(F.max("_hash")).alias("hash"), F.coalesce(F.max("_ts"), F.lit(0)).alias("ts"), F.coalesce(F.max("_piped"), earliest("_author"), F.lit("")).alias("author"), F.coalesce(F.max("_said"), earliest("_subject"), F.lit("")).alias("subject"),
        F.max("_one").alias("_one"), F.sum("_added").alias("_added"), F.sum("_removed").alias("_removed"), F.greatest(F.sum("_stats"), F.coalesce(F.max("_short"), F.lit(0))).alias("_files"),
    ).select(id_col, "hash", "ts", "author", "subject", *[F.when(F.col("_one"), F.lit(0)).otherwise(F.col(f"_{c}")).cast("long").alias(c) for c in ("added", "removed", "files")], F.col("no").alias("paste_pos"))
