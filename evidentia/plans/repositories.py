"""Queries over histories: orders are commits, their line items the lines added and removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import caps_sql, values_sql
from ..operators import history as H
from ..operators import scoring
from ..operators.tables import result
from ..sources.gitlog import commits as read_log, commits_of_lines

_SUBJECTS = ["initial commit", "Add login endpoint with validation and a responsive dashboard for users", "fix typo", "fix import path", "fix lint", "update", "Merge branch dev", "PROJ-12 rename columns", "ugh, please work", "Refactor billing", "wip", "Create payment api component using oauth and jwt tokens for routing"]
#: Hashes (numbers here) of a log text, so that a repository of any size is texts of about a megabyte at most.
LOG_RUN = 10_000
#: Rows that a task of a shuffle is dealt; the number of tasks grows with the tables.
TASK_ROWS = 500_000


def _tasks(spark: SparkSession, rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, lines = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = _tasks(spark, lines.count())  # from the files' footers
    counts = lines.select("l_orderkey", "l_quantity").repartition(n, "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.sum("l_quantity") * 3).cast("long").alias("added"), F.count("*").alias("removed"))
    subject = F.element_at(F.array(*[F.lit(s) for s in _SUBJECTS]), (F.col("o_orderkey") % len(_SUBJECTS) + 1).cast("int"))
    author = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("DEV "), (F.col("o_custkey") % 3).cast("string"))).otherwise(F.concat(F.lit("dev "), (F.col("o_custkey") % 3).cast("string")))
    rows = o.repartition(n, "o_orderkey").join(counts, "o_orderkey", "left")
    # a few repositories are worked through in one sitting
    day = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    ts = F.when(F.col("o_custkey") % 500 % 5 == 0, F.lit(1_500_000_000) + F.col("o_orderkey") % 997 * 30).otherwise(day)
    # in some repositories every second commit is a small fix
    small = (F.col("o_custkey") % 500 % 7 == 3) & (F.col("o_orderkey") % 2 == 0)
    subject, counted = F.when(small, "fix typo").otherwise(subject), F.when(small, 3).otherwise(F.coalesce("added", F.lit(0))).cast("long")
    return rows.select((F.col("o_custkey") % 500).alias("repo_id"), F.col("o_orderkey").alias("hash"), ts.alias("ts"), author.alias("author"), subject.alias("subject"), counted.alias("added"), F.coalesce("removed", F.lit(0)).alias("removed"), F.col("o_orderkey").alias("paste_pos"))


def _history(spark, sf_dir, of):
    """What ``of`` makes of (placed commits, their bursts, features)."""

    def made(folder):
        placed = H.position(commits(spark, sf_dir), folder)
        found = H.bursts(placed, folder)
        return of(placed, found, H.features(placed, found))

    return result(spark, "history", made)


def git_features(spark, sf_dir):
    return _history(spark, sf_dir, lambda placed, found, f: f).withColumn("span_days", F.round("span_days", 6))


def git_hits(spark, sf_dir):
    return _history(spark, sf_dir, lambda placed, found, f: H.fired(f))


def git_signal_counts(spark, sf_dir):
    return git_hits(spark, sf_dir).groupBy("signal_id").agg(F.count("*").alias("repositories"))


def git_authors(spark, sf_dir):
    return result(spark, "history", lambda folder: H.authors(H.position(commits(spark, sf_dir), folder)))


def git_trend(spark, sf_dir):
    return result(spark, "history", lambda folder: H.trend(H.position(commits(spark, sf_dir), folder)))


def git_evidence(spark, sf_dir):
    """The commits that show each signal of a history."""
    return _history(spark, sf_dir, H.evidence).withColumn("evidence", F.array_join("evidence", " | "))


def git_notes(spark, sf_dir):
    """What a reader should know of how each history was read."""
    return _history(spark, sf_dir, lambda placed, found, f: H.notes(f)).withColumn("notes", F.array_join("notes", ","))


def git_reports(spark, sf_dir):
    """Score, verdict and confidence of every repository."""

    def report(placed, found, f):
        hits = H.evidence(placed, found, f).withColumn("fire_seq", F.lit(0))
        return scoring.reports(hits, f.select("repo_id", (F.col("commits") < H.THIN).alias("thin")), "repo_id").select("repo_id", "score", "verdict", "confidence", "ai", "converging", "human")

    return _history(spark, sf_dir, report)


def git_category_totals(spark, sf_dir):
    return _history(spark, sf_dir, lambda placed, found, f: scoring.category_totals(H.evidence(placed, found, f).withColumn("fire_seq", F.lit(0)), "repo_id"))


def _orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def _logs(c, rows, text, between):
    """A log text for each run of LOG_RUN hashes of a repository, with ``text`` for each commit."""
    part = F.struct("repo_id", F.floor(F.col("hash") / LOG_RUN).alias("run")).alias("part")
    spark = c.sparkSession
    return c.withColumn("part", part).repartition(_tasks(spark, rows), "part").groupBy("part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hash", text.alias("x")))), lambda r: r["x"]), between).alias("log"))


def _read(logs):
    return read_log(logs, "part").select("part.repo_id", "hash", "ts", "author", "subject", "added", "removed", "files")


def _hex():
    return F.lpad(F.hex("hash"), 8, "0")


def git_log_parsed(spark, sf_dir):
    """Commits of every repository written as log texts, one for each run of LOG_RUN hashes, and read again from them."""
    line = F.concat_ws("\n", F.concat_ws("|", _hex(), F.col("ts").cast("string"), "author", "subject"), F.concat_ws("\t", F.col("added").cast("string"), F.col("removed").cast("string"), F.lit("src/a.txt")))
    return _read(_logs(commits(spark, sf_dir), _orders(spark, sf_dir), line, "\n\n"))


def git_log_split(spark, sf_dir):
    """The same from lines of one log for each repository, in splits: a commit's lines may lie in two of them."""
    c = commits(spark, sf_dir)
    head = F.concat_ws("|", _hex(), F.col("ts").cast("string"), "author", "subject")
    half = F.floor(F.col("added") / 2)  # the lines added come from two files
    changed = [F.concat_ws("\t", n.cast("string"), m.cast("string"), F.lit(name)) for n, m, name in ((half, F.col("removed"), "src/a.txt"), (F.col("added") - half, F.lit(0), "src/b.txt"))]
    lines = c.select("repo_id", "hash", F.posexplode(F.array(head, F.lit(""), *changed)).alias("k", "line")).withColumn("at", F.col("hash") * 4 + F.col("k"))
    lines = lines.select("repo_id", F.floor((F.col("at") + 2) / LOG_RUN).alias("split"), "at", "line")
    found = commits_of_lines(lines, "repo_id", _tasks(spark, 4 * _orders(spark, sf_dir)))
    return found.select("repo_id", "hash", "ts", "author", "subject", "added", "removed", "files")


def git_log_default(spark, sf_dir):
    """The same in the default format, with a summary of changes below each message."""
    stamp = F.date_format(F.timestamp_seconds("ts"), "EEE MMM d HH:mm:ss yyyy Z")
    counts = F.concat(F.lit(" 2 files changed, "), F.col("added").cast("string"), F.lit(" insertions(+), "), F.col("removed").cast("string"), F.lit(" deletions(-)"))
    text = F.concat(F.lit("commit "), _hex(), F.lit("\nAuthor: "), "author", F.lit(" <dev@example.org>\nDate:   "), stamp, F.lit("\n\n    "), "subject", F.lit("\n    more of the message\n\n"), counts)
    return _read(_logs(commits(spark, sf_dir), _orders(spark, sf_dir), text, "\n\n"))


def git_log_oneline(spark, sf_dir):
    """The same with a line for each commit, which has neither time, author nor counts."""
    return _read(_logs(commits(spark, sf_dir), _orders(spark, sf_dir), F.concat_ws(" ", _hex(), "subject"), "\n"))


QUERIES = {f.__name__: f for f in (git_features, git_hits, git_signal_counts, git_authors, git_trend, git_evidence, git_notes, git_reports, git_category_totals, git_log_parsed, git_log_split, git_log_default, git_log_oneline)}

_LIST = "[" + ", ".join(f"'{s}'" for s in _SUBJECTS) + "]"
_C = f"""n AS (SELECT l_orderkey, (sum(l_quantity) * 3)::BIGINT AS added, count(*) AS removed FROM lineitem GROUP BY 1),
c AS (
    SELECT o_custkey % 500 AS repo_id, o_orderkey AS hash, CASE WHEN o_custkey % 500 % 5 = 0 THEN 1500000000 + o_orderkey % 997 * 30 ELSE epoch(o_orderdate)::BIGINT END AS ts,
        CASE WHEN o_orderkey % 4 = 0 THEN 'DEV ' ELSE 'dev ' END || (o_custkey % 3) AS author, CASE WHEN o_custkey % 500 % 7 = 3 AND o_orderkey % 2 = 0 THEN 'fix typo' ELSE ({_LIST})[o_orderkey % {len(_SUBJECTS)} + 1] END AS subject, CASE WHEN o_custkey % 500 % 7 = 3 AND o_orderkey % 2 = 0 THEN 3 ELSE coalesce(added, 0) END::BIGINT AS added, coalesce(removed, 0) AS removed
    FROM orders LEFT JOIN n ON o_orderkey = l_orderkey
), p AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ts, hash) - 1 AS pos FROM c)"""
_q = lambda p: p.replace("'", "''")
_F = f"""{_C}, x AS (
    SELECT *, max(added + removed > 0) OVER (PARTITION BY repo_id) AS counts, regexp_matches(subject, '{_q(H.FIX)}') OR regexp_matches(subject, '{_q(H.TINY)}') AS isfix,
        sum(added) OVER (PARTITION BY repo_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND 1200 FOLLOWING) AS burst, count(*) OVER (PARTITION BY repo_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND 1200 FOLLOWING) AS inside FROM p
), y AS (SELECT *, isfix AND (NOT counts OR added <= 8) AS small FROM x),
z AS (
    SELECT *, CASE WHEN counts THEN added >= 200 ELSE regexp_matches(subject, '{_q(H.CREATE)}') END AND coalesce(lead(small, 1) OVER w AND lead(small, 2) OVER w AND lead(small, 3) OVER w, false) AS istrail,
        len(regexp_extract_all(regexp_replace(subject, '^[''-]+|-+$', '', 'g'), '[A-Za-z''-]+')) >= 8 AND regexp_matches(subject, '{_q(H.PROMPT)}') AND regexp_matches(subject, '{_q(H.CONNECTIVE)}') AND regexp_matches(subject, '{_q(H.NOUN)}') AS prompt
    FROM y WINDOW w AS (PARTITION BY repo_id ORDER BY pos)
), f AS (
    SELECT repo_id, count(*) AS commits, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed, max(counts) AS has_counts, max(ts > 0) AS has_times, min_by(added, pos) AS first_added,
        regexp_matches(min_by(subject, pos), '{_q(H.INITIAL)}') AS first_initial, max(burst >= 400 AND inside >= 2) AS burst, max(istrail) AS trail, round((max(ts) - min(ts)) / 86400, 6) AS span_days,
        count(DISTINCT ts // 86400) AS days, count(DISTINCT lower(author)) AS authors, count(*) FILTER (prompt) AS prompts, count(*) FILTER (regexp_matches(subject, '{_q(H.GENERIC)}')) AS generic,
        count(*) FILTER (subject <> '') AS subjects, count(*) FILTER (regexp_matches(subject, '{_q(H.MERGE)}')) AS merges, count(*) FILTER (regexp_matches(subject, '{_q(H.ISSUE)}')) AS issues,
        count(*) FILTER (regexp_matches(subject, '{_q(H.MESS)}')) AS mess FROM z GROUP BY 1
)"""
_STEADY = "(commits >= 5 AND span_days >= 21 AND days >= 8)"
_RULES = {
    "gh.big_bang": "has_counts AND added > 0 AND first_added >= 400 AND (first_added * 2 >= added OR first_initial)",
    "gh.velocity": "commits >= 3 AND has_times AND has_counts AND burst",
    "gh.micro_fix_trail": "commits >= 4 AND trail",
    "gh.prompt_messages": "prompts >= 2",
    "gh.single_session": f"commits >= 5 AND has_times AND NOT {_STEADY} AND span_days <= 0.5",
    "gh.generic_messages": "generic >= 3 AND generic * 10 >= subjects * 3",
    "gh.steady_cadence": _STEADY,
    "gh.multiple_authors": "authors >= 2",
    "gh.merges_and_reverts": "merges >= 1",
    "gh.issue_refs": "issues >= 2",
    "gh.human_mess": "mess >= 1",
}
_HITS = f"{_F}, hits AS ({' UNION ALL '.join(f"SELECT repo_id, '{s}' AS signal_id FROM f WHERE {r}" for s, r in _RULES.items())})"
_TOTALS = f"""{_HITS}, known AS (SELECT repo_id, k.* FROM hits JOIN {values_sql()} k USING (signal_id)),
totals AS (SELECT repo_id, category, direction, count(*) AS signals, sum(weight)::DECIMAL(14,2) AS total FROM known GROUP BY ALL),
capped AS (SELECT t.*, CASE WHEN cap IS NULL THEN total ELSE least(total, cap) END::DECIMAL(14,2) AS capped FROM totals t JOIN {caps_sql()} USING (category))"""


_EXCERPT = lambda x, n: f"""'"' || CASE WHEN length(trim(regexp_replace({x}, '\\s+', ' ', 'g'))) > {n} THEN left(trim(regexp_replace({x}, '\\s+', ' ', 'g')), {n - 1}) || '…' ELSE trim(regexp_replace({x}, '\\s+', ' ', 'g')) END || '"'"""
_SOME = lambda n, word: f"{n} || ' {word}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END"
_SHOWN = {
    "gh.prompt_messages": ("prompt", _EXCERPT("subject", 80), True), "gh.generic_messages": (f"regexp_matches(trim(subject), '{_q(H.GENERIC)}')", "'\"' || subject || '\"'", True), "gh.issue_refs": (f"regexp_matches(subject, '{_q(H.ISSUE)}')", _EXCERPT("subject", 70), False),
    "gh.human_mess": (f"regexp_matches(subject, '{_q(H.MESS)}')", _EXCERPT("subject", 70), False), "gh.merges_and_reverts": (f"regexp_matches(subject, '{_q(H.MERGE)}')", _EXCERPT("subject", 70), False),
}
_EVIDENCE = f"""{_HITS}, e AS (SELECT repo_id, pos, ts, added, subject, sum(added) OVER (PARTITION BY repo_id ORDER BY pos) AS upto, max(pos) OVER (PARTITION BY repo_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND 1200 FOLLOWING) AS stop FROM z),
bursts AS (SELECT a.repo_id, a.pos, a.ts, b.upto - a.upto + a.added AS lines, a.stop - a.pos + 1 AS commits FROM e a JOIN e b ON b.repo_id = a.repo_id AND b.pos = a.stop WHERE b.upto - a.upto + a.added >= 400 AND a.stop > a.pos),
picked(repo_id, step, pos, ts, lines, commits) AS (
    SELECT repo_id, 0, min(pos), min_by(ts, pos), min_by(lines, pos), min_by(commits, pos) FROM bursts GROUP BY 1
    UNION ALL SELECT k.repo_id, k.step + 1, min(b.pos), min_by(b.ts, b.pos), min_by(b.lines, b.pos), min_by(b.commits, b.pos) FROM picked k JOIN bursts b ON b.repo_id = k.repo_id AND b.pos >= k.pos + k.commits WHERE k.step < 2 GROUP BY 1, 2
), start AS (SELECT repo_id, min(pos) AS pos FROM z WHERE istrail GROUP BY 1),
said AS ({" UNION ALL ".join(f"SELECT repo_id, '{name}' AS signal_id, {'min(pos)' if once else 'pos'} AS place, {text} AS line FROM z WHERE {test}" + (" GROUP BY 1, 2, 4" if once else "") for name, (test, text, once) in _SHOWN.items())}),
told AS (SELECT *, row_number() OVER (PARTITION BY repo_id, signal_id ORDER BY place) AS k FROM said),
who AS (SELECT repo_id, min_by(author, pos) AS author, min(pos) AS place FROM p GROUP BY repo_id, lower(author)), names AS (SELECT repo_id, array_to_string(list(author ORDER BY place)[1:4], ', ') AS names FROM who GROUP BY 1),
lines AS (
    SELECT repo_id, 'gh.big_bang' AS signal_id, 0 AS place, 'the opening commit adds ' || format('{{:,}}', first_added) || ' lines across 1 file' AS line FROM f
    UNION ALL SELECT repo_id, 'gh.big_bang', 1, 'that is ' || round(first_added * 100 / added)::INT || '% of every line added in the whole history' FROM f WHERE added > 0
    UNION ALL SELECT repo_id, 'gh.big_bang', 2, {_EXCERPT("subject", 70)} FROM p WHERE pos = 0
    UNION ALL SELECT k.repo_id, 'gh.velocity', step, format('{{:,}}', k.lines::BIGINT) || ' lines across ' || k.commits || ' commits in about ' || {_SOME("greatest(1, round((e.ts - k.ts) / 60)::INT)", "minute")} FROM picked k JOIN f USING (repo_id) JOIN e ON e.repo_id = k.repo_id AND e.pos = least(k.pos + k.commits, f.commits - 1)
    UNION ALL SELECT s.repo_id, 'gh.micro_fix_trail', z.pos - s.pos, CASE WHEN z.pos = s.pos THEN 'after a commit of +' || format('{{:,}}', z.added) || ' lines:' ELSE {_EXCERPT("z.subject", 60)} || CASE WHEN z.counts THEN ' (+' || z.added || ')' ELSE '' END END FROM start s JOIN z ON z.repo_id = s.repo_id AND z.pos BETWEEN s.pos AND s.pos + 3
    UNION ALL SELECT repo_id, signal_id, place, line FROM told WHERE k <= CASE WHEN signal_id = 'gh.generic_messages' THEN 3 ELSE 4 END
    UNION ALL SELECT repo_id, 'gh.generic_messages', -1, generic || ' of ' || subjects || ' subjects carry no information' FROM f
    UNION ALL SELECT repo_id, 'gh.steady_cadence', 0, commits || ' commits over ' || round(span_days)::INT || ' days, on ' || days || ' separate days' FROM f
    UNION ALL SELECT repo_id, 'gh.single_session', 0, 'the whole history spans about ' || {_SOME("greatest(1, round(span_days * 24)::INT)", "hour")} FROM f
    UNION ALL SELECT repo_id, 'gh.single_session', 1, commits || ' commits, all on ' || (DATE '1970-01-01' + (t // 86400)::INT)::DATE::VARCHAR FROM f JOIN (SELECT repo_id, min(ts) AS t FROM p WHERE ts > 0 GROUP BY 1) USING (repo_id)
    UNION ALL SELECT repo_id, 'gh.multiple_authors', 0, authors || ' distinct authors: ' || names FROM f JOIN names USING (repo_id)
), firsts AS (SELECT repo_id, signal_id, line, min(place) AS place FROM hits JOIN lines USING (repo_id, signal_id) GROUP BY ALL)
SELECT repo_id, signal_id, array_to_string(list(line ORDER BY place)[1:4], ' | ') AS evidence FROM firsts GROUP BY ALL"""


def report_sql(hits: str, subjects: str, subject: str) -> str:
    """Reports of CTEs: ``hits`` ends with capped and known, ``subjects`` is a relation (subject, thin)."""
    return f"""WITH {hits}, sums AS (
    SELECT s.{subject}, s.thin, -1.0 + coalesce((SELECT sum(CASE WHEN direction = 'ai' THEN capped ELSE -capped END) FROM capped c WHERE c.{subject} = s.{subject}), 0)::DOUBLE AS logit,
        (SELECT count(*) FROM known k WHERE k.{subject} = s.{subject} AND direction = 'ai') AS ai, (SELECT count(*) FROM known k WHERE k.{subject} = s.{subject} AND direction = 'ai' AND category <> 'aesthetic') AS converging,
        (SELECT count(*) FROM known k WHERE k.{subject} = s.{subject} AND direction <> 'ai') AS human, (SELECT count(*) FROM known k WHERE k.{subject} = s.{subject} AND category = 'fingerprint') AS fp FROM {subjects} s
), r1 AS (SELECT *, round(100 / (1 + exp(-logit))) AS raw FROM sums), r2 AS (SELECT *, CASE WHEN converging = 0 AND fp = 0 AND raw > 55 THEN 55.0 ELSE raw END AS guarded FROM r1),
r3 AS (SELECT *, CASE WHEN thin AND fp = 0 THEN round(50 + (guarded - 50) * 0.55) ELSE guarded END AS damped FROM r2),
r4 AS (SELECT *, least(97, greatest(3, CASE WHEN fp = 0 AND damped > 92 THEN 92 ELSE damped END))::INT AS score FROM r3)
SELECT {subject}, score, CASE WHEN fp > 0 THEN 'builder_identified' WHEN score >= 85 AND converging >= 4 THEN 'very_likely_ai' WHEN score >= 72 THEN 'likely_ai' WHEN score >= 58 THEN 'leaning_ai'
    WHEN score >= 42 THEN 'inconclusive' WHEN score >= 25 THEN 'leaning_human' ELSE 'likely_human' END AS verdict,
    CASE WHEN fp > 0 THEN 'high' WHEN thin THEN 'insufficient' WHEN converging >= 4 OR human >= 4 THEN 'moderate' WHEN converging >= 2 OR human >= 2 THEN 'low' ELSE 'insufficient' END AS confidence,
    ai, converging, human FROM r4"""


SQL = {
    "git_features": f"WITH {_F} SELECT * FROM f",
    "git_hits": f"WITH {_HITS} SELECT * FROM hits",
    "git_evidence": f"WITH RECURSIVE {_EVIDENCE}",
    "git_notes": f"WITH {_F} SELECT repo_id, concat_ws(',', CASE WHEN commits < 4 THEN 'thin' END, CASE WHEN NOT has_counts THEN 'no_line_counts' END, CASE WHEN NOT has_times THEN 'no_times' END, 'shape_of_the_work') AS notes FROM f",
    "git_signal_counts": f"WITH {_HITS} SELECT signal_id, count(*) AS repositories FROM hits GROUP BY 1",
    "git_authors": f"WITH {_C} SELECT repo_id, min_by(author, pos) AS author, count(*) AS commits FROM p GROUP BY repo_id, lower(author)",
    "git_trend": f"""WITH {_C}, b AS (SELECT *, count(*) OVER (PARTITION BY repo_id) AS n FROM p)
SELECT repo_id, (ceil((pos + 1) * least(40, n) / n) - 1)::INT AS bucket, count(*) AS commits, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed FROM b GROUP BY 1, 2""",
    "git_reports": report_sql(_TOTALS, "(SELECT repo_id, count(*) < 4 AS thin FROM p GROUP BY 1)", "repo_id"),
    "git_category_totals": f"WITH {_TOTALS} SELECT * FROM capped",
    "git_log_parsed": f"WITH {_C} SELECT repo_id, lower(lpad(to_hex(hash), 8, '0')) AS hash, ts, author, subject, added::BIGINT AS added, removed::BIGINT AS removed, 1::BIGINT AS files FROM c",
    "git_log_split": f"WITH {_C} SELECT repo_id, lower(lpad(to_hex(hash), 8, '0')) AS hash, ts, author, subject, added::BIGINT AS added, removed::BIGINT AS removed, 2::BIGINT AS files FROM c",
    "git_log_default": f"WITH {_C} SELECT repo_id, lower(lpad(to_hex(hash), 8, '0')) AS hash, ts, author, subject, added::BIGINT AS added, removed::BIGINT AS removed, 2::BIGINT AS files FROM c",
    "git_log_oneline": f"WITH {_C} SELECT repo_id, lower(lpad(to_hex(hash), 8, '0')) AS hash, 0::BIGINT AS ts, '' AS author, subject, 0::BIGINT AS added, 0::BIGINT AS removed, 0::BIGINT AS files FROM c",
}
