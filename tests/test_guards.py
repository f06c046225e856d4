"""Plain texts that are looked for before patterns, and what is worked out once."""

import re
import time

from pyspark.sql import functions as F

from evidentia.functions import guards, text
from evidentia.operators import code, pages
from evidentia.plans import web


def test_guards_are_in_every_match(spark):
    assert guards.guard(r"(?i)\b(?:bg|text)-(?:Indigo|violet)-\d{2,3}\b") == ("indigo", "violet")
    assert guards.guard(r"(?s)<!--(.*?)-->") == ("<!--",) and guards.guard(r"\d+|abc") is None and guards.guard(r"(?:abc)?x?") is None and guards.guard(r"é+") is None
    patterns = [p for ps in (*pages.FINGERPRINTS.values(), pages.BUILDERS.values(), pages.STACK, pages.HEAD_PARTS, pages.OPERATIONS, pages.CMS.values(), *([f"(?iu){c}" for c in x] for x in pages.CLICHES.values())) for p in ps]
    # the simple ones match themselves in any case, and with letters that are the same without case
    rows = [(k, t) for k, p in enumerate(patterns) if re.fullmatch(r"[A-Za-z' _/-]+", q := re.sub(r"^\(\?iu?\)", "", p).replace("\\.", "_")) for t in (q, q.upper(), q.upper().replace("I", "İ"), q.replace("s", "ſ").replace("k", "K").replace("i", "ı"))]
    assert len(rows) > 100
    df = spark.createDataFrame(rows, "k int, s string").withColumn("f", guards.fold(F.col("s")))
    for k in {k for k, _ in rows}:
        plain, may = F.col("s").rlike(patterns[k]), guards.seen(F.col("f"), patterns[k])
        df = df.withColumn("wrong", F.col("wrong") | ((F.col("k") == k) & plain & ~may) if "wrong" in df.columns else (F.col("k") == k) & plain & ~may)
    assert df.filter("wrong").collect() == []


def test_language_is_told_from_one_lower_case_text(spark):
    said = ["le LA les des vous " * 15, "más FÜR más el la los para con que una " * 8, "le le le " * 30, "the and for " * 10, None]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k int, s string").select("k", text.declared_language(F.col("s")).alias("lang"))
    assert [r["lang"] for r in df.sort("k").collect()] == ["fr", "es", "fr", "", ""]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(s") == 1


def test_costly_rules_have_several_tasks_for_each_core(spark):
    some = spark.range(0, 1000, 1, 5)  # four cores
    assert pages.spread(some).rdd.getNumPartitions() == 16 and pages.spread(some.repartition(40)).rdd.getNumPartitions() == 40


def test_rules_of_pages_run_once_for_a_site(spark, tmp_path):
    rows = [(k, f"https://a{k % 2}.example/{k}", "<p>Made in Bolt</p>" * 3) for k in range(6)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    plan = web._site_hits(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "gptengineer" not in plan


def test_texts_are_worked_out_once_and_all_parts_of_a_match_are_needed(spark):
    assert {"%"} in map(set, guards._guards(pages.STATISTICS[1])) and guards.guard(r"\x{2014}") == ("—",)
    df = spark.createDataFrame([("a  b &amp; c\t-\r\n",), ("one  two",)], "s string")
    assert [r[0] for r in df.select(text.visible_text(F.col("s"))).collect()] == ["a b & c -", "one two"]
    plan = df.select(text.visible_text(F.col("s")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<noscript") == 1


def test_words_tell_what_a_text_may_hold(spark):
    rows = ['<a class="bg-indigo-500">Made in Bolt</a>\nsame line\nsame line', "é日-İstanbul \u212a9 \u017ftar", "", "a-b_c1"]
    df = spark.createDataFrame([(x,) for x in rows], "s string").select(guards.fold(F.col("s")).alias("f")).withColumn("w", guards.words(F.col("f")))
    assert [r["w"] for r in df.collect()] == ["a class bg indigo 500 made in bolt same line", "istanbul k9 star", "", "a b c1"]
    looked = ["indigo", "bg-indigo", "made in", "é", "class=", "class-", "line\nsame", "k9", "star", "-", "c1", "lin", "b_c", "b-c"]
    told = df.select(*[(guards.held(F.col("f"), t, F.col("w")) == F.contains("f", F.lit(t))).alias(f"t{k}") for k, t in enumerate(looked)])
    assert all(all(r) for r in told.collect())
    # one run is looked for among the words only
    assert str(guards.held(F.col("f"), "indigo", F.col("w"))) == str(F.contains(F.col("w"), F.lit("indigo")))
    looks = pages.prepare(spark.createDataFrame([(1, "", "x")], "page_id int, url string, html string")).select(pages.like("html", r"(?i)tailwind-merge"))
    assert looks._jdf.queryExecution().analyzed().toString().count("words_page") >= 2


def test_patterns_led_by_their_first_character_match_the_same(spark):
    assert guards.led(r"(?i)\b(?:get|x?set)\w+") == r"(?i)(?=[\x{67}\x{73}\x{78}])\b(?:get|x?set)\w+"
    assert all(guards.led(p) == p for p in (r"catch\s*\(", r"\w+x", r"(?i)x*", r"\p{L}a|b", r"(?:a|)b?", r"[[a-z]&&[b]]", r"(?s).a", "("))
    patterns = [r"(?iu)\b(?:keep|sip|it)s\b", r"(?i)k\d", r"(?<![\w$])else\b", r"(?m)^(?:a|b)+$", r"[\"'`](?:x|y)", r"(?iu)(?:é|ß)t", r"(?i)[j-l]\d|\x{2014}", r"(?i)(?:s|t)(\w)\1"]
    texts = ["Keeps \u212aeeps SIP sips ſips it's İTS ıts", "k1 K2 \u212a3 —", "else $else elsewhere; else", "ab\nba\nc\na", "'x \"y `z", "Ét ßT ẞt ét", "stt sTT TSS", ""]
    assert sum(guards.led(p) != p for p in patterns) == len(patterns)
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    every = lambda p: F.regexp_extract_all("s", F.lit(p), F.lit(0))
    assert all(all(r) for r in df.select(*[(every(p) == every(guards.led(p))).alias(f"p{k}") for k, p in enumerate(patterns)]).collect())
    assert all(any(r) for r in zip(*df.select(*[(F.size(every(p)) > 0).alias(f"p{k}") for k, p in enumerate(patterns)]).collect(), strict=True))


def test_language_of_an_open_block_takes_linear_time(spark):
    texts = ["a {" + " b: c;" * 4000, "a {" + " b: c;" * 4000 + "} .x-y\n{ p: q; } z{:} w{;:;}", "text"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, src string")
    began = time.time()
    assert [r["code_language"] for r in code.sources(df, "k").sort("subject_id").collect()] == ["unknown", "css", "unknown"]
    assert time.time() - began < 20


def test_names_are_counted_among_few_and_many(spark):
    few, many = ("".join(f"function name{k}() {{}}\n" for k in range(n)) + "name1(); name2();\nimport old from 'x'\n" for n in (9, 200))
    found = code.single_use(code.sources(spark.createDataFrame([(1, few), (2, many), (3, "plain text")], "k int, src string"), "k")).sort("subject_id")
    assert [(r["declares"], r["dead_imports"], r["dead_names"]) for r in found.collect()] == [(True, 1, 7), (True, 1, 198), (False, 0, 0)]
