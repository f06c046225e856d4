"""The pipeline's stages on small tables with odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"


def table(spark):
    random.seed(9)
    en, de = "the house and that water with thing".split(), "das haus und dass wasser mit schön".split()
    rows = []
    for i in range(120):
        words = [random.choice(en if i % 3 else de) + random.choice(["", "s", "t", "ing"]) for _ in range(random.randint(8, 60))]
        rows.append((i, " ".join(words) + (" you wretched scoundrel" if i % 6 == 1 else ""), "en" if i % 3 else "de", f"src{i % 4}", 1, 0.5, "x"))
    rows += [(500, None, "en", "src0", 0, 0.5, "x"), (501, "", "en", None, 0, 0.5, "x"), (502, "12 !!", None, "src1", 0, 0.5, "x"), (503, rows[2][1], None, "src1", 0, 0.5, "x"), (503, rows[2][1], None, "src1", 0, 0.5, "x"), (None, rows[4][1] + " and the end", "en", "src2", 0, 0.5, "x"), (504, "the water " * 20_000, "en", "src3", 0, 0.5, "x")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    table(spark).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 1)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def slow_groups(rows):
    """Groups of distinct (id, text) rows linked by five-word shingles, by comparing all pairs; rows without words stand alone."""
    def shingles(text):
        w = re.findall(r"[^ \t-\r]+", (text or "").lower())
        n = min(5, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()

    docs = sorted({(r["doc_id"], r["text"]) for r in rows}, key=str)
    sets = [shingles(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return set(group)


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=str)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = P.language(spark, docs, sf_dir)
    assert kept.columns == list(P.COLUMNS)
    # texts without a letter go; all others stay
    assert ids(kept) == sorted([*range(120), 503, 503, 504, None], key=str)
    calm = ids(P.clean(spark, docs, sf_dir))
    assert not set(calm) & {i for i in range(120) if i % 6 == 1} and set(range(0, 120, 6)) | {500, 501, 502, 504} <= set(calm)
    single = P.near_duplicates(spark, docs, sf_dir)
    found = ids(single)
    # 2 and 503 are copies: one of them stays
    assert single.columns == list(P.COLUMNS) and len(found) == len(slow_groups(docs.collect())) and {500, 501, 502, 504} <= set(found)
    assert len({2, 503} & set(found)) == 1
    copied = docs.filter("doc_id = 4").unionByName(docs.filter("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    assert P.near_duplicates(spark, copied, sf_dir).count() == 1
    again = P.near_duplicates(spark, docs.filter("doc_id = 503"), sf_dir)
    assert ids(again) == [503]
    different = docs.filter("doc_id in (3, 5)").withColumn("doc_id", F.lit(7).cast("long"))  # one id, two texts
    assert ids(P.near_duplicates(spark, different, sf_dir)) == [7, 7] and ids(P.mixed(spark, different.unionByName(docs.filter("doc_id is null")), sf_dir)) != []
    mixed = P.mixed(spark, docs.filter("doc_id <> 504"), sf_dir)
    assert mixed.columns == list(P.COLUMNS) and 0 < mixed.count() <= 123
    pieces = P.packed(spark, docs, sf_dir)
    total = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"), F.count_if(F.col("start") == 0).alias("rows"))
    assert total.filter("n <> t * rows").count() == 0


def test_empty_tables(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
