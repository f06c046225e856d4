"""Version-control histories: signals over commits (repo_id, hash, ts, author, subject, added, removed, files).

A history may be of any length. What depends on order is worked out on two levels: commits are dealt into blocks by ranges
of their order, a window numbers or sums a block, and sums of whole blocks are added; so no task holds a repository.
position() numbers the commits oldest first, bursts() and trails() find runs, features() gives one row of numbers per
repository, fired() the signals, and evidence() the commits that show them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import excerpt
from .tables import Folder

#: Commits of a block, about.
BLOCK = 100_000
# Seconds and lines of a burst, lines of a large and a small commit.
BURST_SECONDS, BURST_LINES, LARGE, SMALL, THIN = 1200, 400, 200, 8, 4
DAY = 86400

# What subjects are recognised by.
INITIAL = r"(?i)^(?:initial|first)\b|^init\b|initial commit"
FIX = r"(?i)^(?:fix|fixed|fixes|correct|update)\b.{0,40}\b(?:typo|import|imports|path|build|lint|error|missing|syntax|reference|name|case|indent|format)\b"
TINY = r"(?i)^(?:fix typo|typo|oops|fix|fix build|fix lint|small fix|minor fix|fix error|fix import)\.?$"
CREATE = r"(?i)^(?:initial|add|implement|create|build)\b"
PROMPT = r"(?i)^(?:add|implement|create|build|set ?up|integrate|develop)\b"
CONNECTIVE = r"(?i)\b(?:with|using|including|and|for)\b"
NOUN = r"(?i)\b(?:auth\w*|api|endpoint|component|dashboard|integration|validation|middleware|schema|jwt|oauth|crud|responsive|payment|database|routing|state management)\b"
GENERIC = r"(?i)^(?:update|updates|updated|changes|change|changed|fix|fixes|fixed|wip|misc|stuff|edit|edits|new|test|tests|commit|final|done|cleanup|clean up|refactor)\.?$"
ISSUE = r"#[0-9]{1,6}\b|\b[A-Z]{2,8}-[0-9]{1,6}\b"
MESS = r"(?i)\b(?:oops|argh|ugh|whoops|sigh|dammit|damn|finally|actually|for real|this time|please work|why (?:is|does|won'?t)|forgot|stupid|revert the revert|no really|last try|hopefully)\b"
MERGE = r"(?i)^(?:merge|revert)\b"


def running(rows: DataFrame, order: list[str], sums: dict[str, Column], folder: Folder, block: int = BLOCK) -> DataFrame:
    """rows with running sums over a repository in the given order, the row itself included.

    Rows are dealt into blocks by ranges of (repo_id, order) and written, so that their blocks stay; a window sums each block,
    and what comes before it is the sum of the repository's earlier blocks, of which there are few.
    """
    rows = folder.write(rows, "rows")
    parts = max(1, -(-rows.count() // block))
    dealt = folder.write(rows.repartitionByRange(parts, "repo_id", *order).withColumn("_block", F.spark_partition_id()), "blocks")
    totals = dealt.groupBy("repo_id", "_block").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    earlier = Window.partitionBy("repo_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    before = totals.select("repo_id", "_block", *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in sums])
    inside = Window.partitionBy("repo_id", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = dealt.join(before, ["repo_id", "_block"])
    return found.select(*rows.columns, *[(F.sum(c).over(inside) + F.col(f"_{name}")).alias(name) for name, c in sums.items()])


def position(commits: DataFrame, folder: Folder, block: int = BLOCK) -> DataFrame:
    """commits with pos, 0 for the oldest: by (ts, hash) if the repository has any time stamp, else in reverse order of paste_pos."""
    timed = commits.groupBy("repo_id").agg(F.max(F.coalesce(F.col("ts") > 0, F.lit(False))).alias("_timed"))
    keyed = commits.join(timed, "repo_id").withColumn("_1", F.when(F.col("_timed"), F.coalesce("ts", F.lit(0)))).withColumn("_2", F.when(F.col("_timed"), F.col("hash"))).withColumn("_3", -F.col("paste_pos"))
    placed = running(keyed, ["_1", "_2", "_3"], {"pos": F.lit(1).cast("long")}, folder, block)
    return folder.write(placed.withColumn("pos", F.col("pos") - 1).drop("_timed", "_1", "_2", "_3"), "placed")


def bursts(placed: DataFrame, folder: Folder, block: int = BLOCK) -> DataFrame:
    """(repo_id, pos, ts, lines, commits) of each commit with a time: what is committed from it on within BURST_SECONDS.

    Each commit sends a probe to the end of its time; running sums up to the probe, less those before the commit, are the burst.
    """
    stamped = placed.filter("ts > 0")
    own = stamped.select("repo_id", "ts", F.lit(0).alias("kind"), "pos", F.coalesce("added", F.lit(0)).cast("long").alias("n"), F.lit(1).cast("long").alias("k"))
    probes = stamped.select("repo_id", (F.col("ts") + BURST_SECONDS).alias("ts"), F.lit(1).alias("kind"), "pos", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"))
    sums = running(own.unionByName(probes), ["ts", "kind", "pos"], {"lines": F.col("n"), "commits": F.col("k")}, folder, block)
    end = F.lit(1) == F.col("kind")
    both = sums.groupBy("repo_id", "pos").agg(
        F.min("ts").alias("ts"), (F.max(F.when(end, F.col("lines"))) - F.max(F.when(~end, F.col("lines") - F.col("n")))).alias("lines"), (F.max(F.when(end, F.col("commits"))) - F.max(F.when(~end, F.col("commits") - 1))).alias("commits")
    )
    return folder.write(both, "bursts")


def trails(placed: DataFrame) -> DataFrame:
    """(repo_id, pos, large, creating, added): commits that three small fixes follow; large by its lines, creating by its subject."""
    subject = F.coalesce("subject", F.lit(""))
    fixes = placed.filter((subject.rlike(FIX) | subject.rlike(TINY)) & (F.coalesce("added", F.lit(0)) <= SMALL))
    followed = fixes.select("repo_id", F.explode(F.array(*[F.col("pos") - k for k in (1, 2, 3)])).alias("pos")).groupBy("repo_id", "pos").count().filter("count = 3")
    starts = placed.select("repo_id", "pos", "added", (F.coalesce("added", F.lit(0)) >= LARGE).alias("large"), subject.rlike(CREATE).alias("creating")).filter("large or creating")
    return starts.join(followed.select("repo_id", "pos"), ["repo_id", "pos"])


def authors(commits: DataFrame) -> DataFrame:
    """(repo_id, author, commits): names that differ in case only are one, spelled as the oldest commit has it."""
    named = commits.filter(F.trim("author") != "")
    return named.groupBy("repo_id", F.lower(F.trim("author")).alias("_key")).agg(F.min_by("author", "pos").alias("author"), F.count("*").alias("commits")).drop("_key")


def trend(commits: DataFrame, buckets: int = 40) -> DataFrame:
    """(repo_id, bucket, commits, added, removed): at most 40 runs of commits, as even as can be."""
    sizes = commits.groupBy("repo_id").agg(F.count("*").alias("_n"))
    b = F.least(F.lit(buckets), F.col("_n"))
    bucket = (F.ceil((F.col("pos") + 1) * b / F.col("_n")) - 1).cast("int")
    return commits.join(sizes, "repo_id").withColumn("bucket", bucket).groupBy("repo_id", "bucket").agg(F.count("*").alias("commits"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))


def word_count(text: Column) -> Column:
    """Runs of ASCII letters, apostrophes and hyphens, those at the ends of the text trimmed first."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^['-]+|-+$", "")
    return F.regexp_count(trimmed, F.lit(r"[A-Za-z'-]+"))


def is_prompt(subject: Column) -> Column:
    """Whether a subject restates a specification rather than a change."""
    return (word_count(subject) >= 8) & subject.rlike(PROMPT) & subject.rlike(CONNECTIVE) & subject.rlike(NOUN)


def features(placed: DataFrame, found_bursts: DataFrame) -> DataFrame:
    """A row of numbers per repository from position() and bursts()."""
    stamped = F.col("ts") > 0
    subject = F.coalesce("subject", F.lit(""))
    first = F.min_by(F.struct("added", "subject"), "pos")
    base = placed.groupBy("repo_id").agg(
        F.count("*").alias("commits"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.max(F.coalesce(F.col("added") + F.col("removed") > 0, F.lit(False))).alias("has_counts"), F.max(stamped).alias("has_times"),
        first["added"].alias("first_added"), F.coalesce(first["subject"].rlike(INITIAL), F.lit(False)).alias("first_initial"),
        ((F.max(F.when(stamped, F.col("ts"))) - F.min(F.when(stamped, F.col("ts")))) / DAY).alias("span_days"), F.count_distinct(F.when(stamped, F.floor(F.col("ts") / DAY))).alias("days"),
        F.count_distinct(F.when(F.trim("author") != "", F.lower(F.trim("author")))).alias("authors"), F.count_if(is_prompt(subject)).alias("prompts"), F.count_if(F.trim(subject).rlike(GENERIC)).alias("generic"),
        F.count_if(subject != "").alias("subjects"), F.count_if(subject.rlike(MERGE)).alias("merges"), F.count_if(subject.rlike(ISSUE)).alias("issues"), F.count_if(subject.rlike(MESS)).alias("mess"),
    )
    fast = found_bursts.groupBy("repo_id").agg(F.max(is_burst()).alias("burst"))
    runs = trails(placed).groupBy("repo_id").agg(F.max("large").alias("_large"), F.max("creating").alias("_creating"))
    rows = base.join(fast, "repo_id", "left").join(runs, "repo_id", "left").withColumn("span_days", F.coalesce("span_days", F.lit(0.0))).withColumn("burst", F.coalesce("burst", F.lit(False)))
    return rows.withColumn("trail", F.coalesce(F.when(F.col("has_counts"), F.col("_large")).otherwise(F.col("_creating")), F.lit(False))).drop("_large", "_creating")


def is_burst() -> Column:
    return (F.col("lines") >= BURST_LINES) & (F.col("commits") >= 2)


def fired(f: DataFrame) -> DataFrame:
    """(repo_id, signal_id) from features; repositories of fewer than one commit don't occur."""
    c = F.col
    steady = (c("commits") >= 5) & (c("span_days") >= 21) & (c("days") >= 8)
    rules = {
        "gh.big_bang": c("has_counts") & (c("added") > 0) & (c("first_added") >= 400) & ((c("first_added") * 2 >= c("added")) | c("first_initial")),
        "gh.velocity": (c("commits") >= 3) & c("has_times") & c("has_counts") & c("burst"),
        "gh.micro_fix_trail": (c("commits") >= 4) & c("trail"),
        "gh.prompt_messages": c("prompts") >= 2,
        "gh.single_session": (c("commits") >= 5) & c("has_times") & ~steady & (c("span_days") <= 0.5),
        "gh.generic_messages": (c("generic") >= 3) & (c("generic") * 10 >= c("subjects") * 3),
        "gh.steady_cadence": steady,
        "gh.multiple_authors": c("authors") >= 2,
        "gh.merges_and_reverts": c("merges") >= 1,
        "gh.issue_refs": c("issues") >= 2,
        "gh.human_mess": c("mess") >= 1,
    }
    names = F.filter(F.array(*[F.when(rule, F.lit(s)) for s, rule in rules.items()]), lambda x: x.isNotNull())
    return f.select("repo_id", F.explode(names).alias("signal_id"))


def _plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def _separate_bursts(found: DataFrame, most: int = 3) -> DataFrame:
    """(repo_id, at, pos, ts, lines, commits): the first bursts of each repository that don't overlap; at counts them from 0."""
    burst = found.filter(is_burst())
    after = burst.select("repo_id").distinct().withColumn("_from", F.lit(0).cast("long"))
    picked = None
    for at in range(most):
        left = burst.join(after, "repo_id").filter(F.col("pos") >= F.col("_from"))
        one = left.groupBy("repo_id").agg(F.min(F.struct("pos", "ts", "lines", "commits")).alias("b")).select("repo_id", F.lit(at).alias("at"), "b.*")
        picked = one if picked is None else picked.unionByName(one)
        after = one.select("repo_id", (F.col("pos") + F.col("commits")).alias("_from"))
    return picked


def evidence(placed: DataFrame, found_bursts: DataFrame, f: DataFrame) -> DataFrame:
    """(repo_id, signal_id, evidence): at most four lines that show why a signal fires, from features() f and what it is made of.

    Subjects that show a signal are limited to four of each repository before they are shuffled.
    """
    subject = F.coalesce("subject", F.lit(""))
    quoted = lambda s, n: F.concat(F.lit('"'), excerpt(s, n), F.lit('"'))
    hits = fired(f)
    lines = []  # (repo_id, signal_id, at, line)

    def line(rows: DataFrame, signal: str, at: Column, text: Column) -> None:
        lines.append(rows.select("repo_id", F.lit(signal).alias("signal_id"), at.cast("long").alias("at"), text.alias("line")))

    c = F.col
    first = placed.filter("pos = 0").select("repo_id", "subject", c("added").alias("_first"), c("files") if "files" in placed.columns else F.lit(1).alias("files"))
    opening = f.join(first, "repo_id")
    line(opening, "gh.big_bang", F.lit(0), F.concat(F.lit("the opening commit adds "), F.format_number("_first", 0), F.lit(" lines across "), _plural(c("files"), "file")))
    line(opening, "gh.big_bang", F.lit(1), F.concat(F.lit("that is "), F.round(c("_first") * 100 / c("added")).cast("int").cast("string"), F.lit("% of every line added in the whole history")))
    line(opening, "gh.big_bang", F.lit(2), quoted(subject, 70))
    # a burst's minutes run to the commit after it, or to the last one
    picked = _separate_bursts(found_bursts).join(f.select("repo_id", c("commits").alias("_n")), "repo_id").withColumn("_end", F.least(c("pos") + c("commits"), c("_n") - 1))
    ended = picked.join(placed.select("repo_id", c("pos").alias("_end"), c("ts").alias("_until")), ["repo_id", "_end"])
    minutes = F.greatest(F.lit(1), F.round((c("_until") - c("ts")) / 60)).cast("int")
    line(ended, "gh.velocity", c("at"), F.concat(F.format_number("lines", 0), F.lit(" lines across "), c("commits").cast("string"), F.lit(" commits in about "), _plural(minutes, "minute")))
    start = trails(placed).join(f.select("repo_id", "has_counts"), "repo_id").filter((c("has_counts") & c("large")) | (~c("has_counts") & c("creating"))).groupBy("repo_id", "has_counts").agg(F.min_by("added", "pos").alias("_big"), F.min("pos").alias("_start"))
    line(start, "gh.micro_fix_trail", F.lit(0), F.concat(F.lit("after a commit of +"), F.format_number("_big", 0), F.lit(" lines:")))
    steps = start.select("repo_id", "has_counts", "_start", F.explode(F.array(*[c("_start") + k for k in (1, 2, 3)])).alias("pos")).join(placed.select("repo_id", "pos", "subject", "added"), ["repo_id", "pos"])
    line(steps, "gh.micro_fix_trail", c("pos") - c("_start"), F.concat(quoted(subject, 60), F.when(c("has_counts"), F.concat(F.lit(" (+"), c("added").cast("string"), F.lit(")"))).otherwise("")))
    said = F.filter(F.array(*[F.when(test, F.struct(F.lit(name).alias("signal_id"), text.alias("line"))) for name, test, text in (
        ("gh.prompt_messages", is_prompt(subject), quoted(subject, 80)), ("gh.generic_messages", F.trim(subject).rlike(GENERIC), F.concat(F.lit('"'), subject, F.lit('"'))), ("gh.issue_refs", subject.rlike(ISSUE), quoted(subject, 70)),
        ("gh.human_mess", subject.rlike(MESS), quoted(subject, 70)), ("gh.merges_and_reverts", subject.rlike(MERGE), quoted(subject, 70)),
    )]), lambda x: x.isNotNull())
    told = placed.select("repo_id", c("pos").alias("at"), F.explode(said).alias("s")).select("repo_id", "at", "s.*")
    once = c("signal_id").isin("gh.prompt_messages", "gh.generic_messages")  # these show different subjects
    told = told.filter(once).groupBy("repo_id", "signal_id", "line").agg(F.min("at").alias("at")).unionByName(told.filter(~once))
    told = told.withColumn("_k", F.row_number().over(Window.partitionBy("repo_id", "signal_id").orderBy("at"))).filter(c("_k") <= 4)
    lines.append(told.filter((c("signal_id") != "gh.generic_messages") | (c("_k") <= 3)).select("repo_id", "signal_id", "at", "line"))
    line(f, "gh.generic_messages", F.lit(-1), F.concat(c("generic").cast("string"), F.lit(" of "), c("subjects").cast("string"), F.lit(" subjects carry no information")))
    days = F.round("span_days").cast("int").cast("string")
    line(f, "gh.steady_cadence", F.lit(0), F.concat(c("commits").cast("string"), F.lit(" commits over "), days, F.lit(" days, on "), c("days").cast("string"), F.lit(" separate days")))
    line(f, "gh.single_session", F.lit(0), F.concat(F.lit("the whole history spans about "), _plural(F.greatest(F.lit(1), F.round(c("span_days") * 24)).cast("int"), "hour")))
    began = placed.filter("ts > 0").groupBy("repo_id").agg(F.min("ts").alias("_ts")).join(f, "repo_id")
    line(began, "gh.single_session", F.lit(1), F.concat(c("commits").cast("string"), F.lit(" commits, all on "), F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c("_ts") / DAY).cast("int")).cast("string")))
    named = placed.filter(F.trim("author") != "").groupBy("repo_id", F.lower(F.trim("author")).alias("_a")).agg(F.min_by("author", "pos").alias("author"), F.min("pos").alias("_at"))
    named = named.withColumn("_k", F.row_number().over(Window.partitionBy("repo_id").orderBy("_at"))).filter(c("_k") <= 4)
    names = named.groupBy("repo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "author"))), lambda x: x["author"]), ", ").alias("names")).join(f, "repo_id")
    line(names, "gh.multiple_authors", F.lit(0), F.concat(c("authors").cast("string"), F.lit(" distinct authors: "), c("names")))
    every = lines[0]
    for more in lines[1:]:
        every = every.unionByName(more)
    shown = every.join(hits, ["repo_id", "signal_id"], "left_semi").groupBy("repo_id", "signal_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]).alias("evidence"))
    return hits.join(shown, ["repo_id", "signal_id"], "left").withColumn("evidence", F.slice(F.array_distinct(F.coalesce("evidence", F.array().cast("array<string>"))), 1, 4))


def notes(f: DataFrame) -> DataFrame:
    """(repo_id, notes): codes of what a reader should know of how a history was read."""
    c = F.col
    said = {"thin": c("commits") < THIN, "no_line_counts": ~c("has_counts"), "no_times": ~F.coalesce("has_times", F.lit(False)), "shape_of_the_work": F.lit(True)}
    return f.select("repo_id", F.filter(F.array(*[F.when(test, F.lit(n)) for n, test in said.items()]), lambda x: x.isNotNull()).alias("notes"))
