"""Queries and operators on inputs beyond the sizes of the small tables: nothing may be left out."""

from evidentia.operators import assets, links
from evidentia.operators.tables import Folder
from evidentia.plans import repositories
from evidentia.sources import gitlog


def test_every_commit_is_written_and_read_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repositories, "LOG_RUN", 7)
    # repository 499 is hot, and no repository below 40 has more than one commit
    orders = [(k, 499 if k % 2 else k % 500, k) for k in range(200)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, n int").selectExpr("o_orderkey", "o_custkey", "date_add(date'2020-01-01', n) o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, 1.0 * (k % 5)) for k in range(0, 200, 3)], "l_orderkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = repositories.git_log_parsed(spark, str(tmp_path)).collect()
    expected = {(r["repo_id"], f"{r['hash']:08x}", r["ts"], r["author"], r["subject"], r["added"], r["removed"], 1) for r in repositories.commits(spark, str(tmp_path)).collect()}
    assert len(got) == 200 and {tuple(r) for r in got} == expected and sum(r["repo_id"] == 499 for r in got) == 100


def test_depth_has_no_limit(spark):
    # a chain of pages, a cycle and a site of its own
    pages = [("deep", k) for k in range(14)] + [("flat", k) for k in range(4)] + [("alone", 7)]
    steps = [("deep", k, k + 1) for k in range(13)] + [("deep", 12, 3), ("deep", 2, 2), ("flat", 0, 1), ("flat", 0, 2), ("flat", 1, 2), ("flat", 2, 99), ("flat", None, 1)]
    entries = spark.createDataFrame([("deep", 0), ("flat", 0), ("alone", 7), ("none", 1)], "site string, key long")
    folder = Folder(spark, "depth")
    found = links.crawl_depth(spark.createDataFrame(pages, "site string, key long"), spark.createDataFrame(steps, "site string, source long, target long"), entries, folder).collect()
    folder.drop()
    assert sorted(map(tuple, found)) == sorted([("deep", k, k) for k in range(14)] + [("flat", 0, 0), ("flat", 1, 1), ("flat", 2, 1), ("alone", 7, 0)])


def test_log_texts_are_read_within_their_rows(spark):
    log = "3 files changed\n\naaaaaaa|1500000000| a |one\n1\t2\tx\n-\t-\ty\ncommit bbbbbbb\nAuthor: b <b@c>\nDate:   Fri Jul 14 02:40:00 2017 +0000\n\n    two\n    more\n\n 2 files changed, 5 insertions(+), 1 deletion(-)\r\nccccccc three\n7\t7\tz"
    found = gitlog.commits(spark.createDataFrame([(1, log), (2, ""), (3, None)], "repo_id int, log string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    expected = [("aaaaaaa", 1500000000, "a", "one", 1, 2, 2, 1), ("bbbbbbb", 1500000000, "b", "two", 5, 1, 2, 2), ("ccccccc", 0, "", "three", 0, 0, 0, 3)]
    assert [tuple(r)[1:] for r in found.sort("paste_pos").collect()] == expected
    # as lines, of which a commit's lie in several splits
    lines = spark.createDataFrame([("r", k // 3, k, x) for k, x in enumerate(log.replace("\r", "").split("\n"))], "log string, split long, at long, line string")
    for tasks in (None, 5):
        assert [tuple(r)[1:] for r in gitlog.commits_of_lines(lines, tasks=tasks).sort("paste_pos").collect()] == expected


def test_tasks_grow_with_the_tables(spark, tmp_path, monkeypatch):
    spark.range(60).selectExpr("id o_orderkey", "id o_custkey", "date'2020-01-01' o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(120).selectExpr("id div 2 l_orderkey", "1.0D l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(repositories, "TASK_ROWS", 10)
    plan = lambda q: q(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert all(plan(q).count("RepartitionByExpression") >= 3 for q in (repositories.git_log_default, repositories.git_log_parsed, repositories.git_log_split))
    assert repositories._tasks(spark, 120) == 12 and repositories.git_log_split(spark, str(tmp_path)).count() == 60


def test_sources_behind_scripts_are_read_to_their_end(spark):
    # more than 800,000 bytes before the line that tells, in one map and over two
    padding = "const value = 1; // plain\n" * 32_000
    maps = lambda *contents: [("app.js.map", ["src/a.ts"], x) for x in contents]
    rows = [(1, {}, maps(padding + "// sure, here's a helper\n")), (2, {}, maps(padding, "// sure, here's a helper\n")), (3, {}, maps(padding))]
    table = spark.createDataFrame(rows, "page_id int, assets map<string,string>, source_maps array<struct<url:string,sources:array<string>,content:string>>")
    found = assets.hits(assets.sub_subjects(table)).filter("signal_id = 'cd.assistant_chatter'").collect()
    assert sorted((r["page_id"], tuple(r["evidence"])) for r in found) == [(k, (f"line {n}: // sure, here's a helper",)) for k, n in ((1, 32_002), (2, 32_003))]
