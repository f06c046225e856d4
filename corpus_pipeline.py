"""Five operators applied one after another to documents: each stage's rows are written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import language_id, minhash, mixing, packing, queries, toxicity
from evidentia.llm.scratch import fold, join_checked, write

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language is less certain than this, or that have no letter, are rejected.
LEAST_CERTAIN = 0.5
#: The part of all words that mixing may take. A document is taken once at most, and whole or not at all.
MIX_SHARE = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. An empty or null text has none, so it goes; a certain language stays, whichever it is."""
    model = language_id.train(docs, fold(F.col("doc_id"), 3) != 1)
    found = language_id.predict(docs, model, keep=COLUMNS)
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_CERTAIN)).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't likelier toxic than not. Null and empty texts stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(F.col("doc_id"), 5) != 0)
    return toxicity.score(docs, model, keep=COLUMNS).filter("score < 0.5").select(*COLUMNS)


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with ``_key``: the document's id, or a hash of id and text for rows without an id or with one that repeats.

    So only rows equal in id and text share a key. The second value tells whether some may.
    """
    own, text = F.col("doc_id"), F.col("text")
    again = write(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    n, none = again.df.count(), docs.filter("doc_id is null").limit(1).count()
    if not n:
        return docs.withColumn("_key", F.coalesce(own, F.xxhash64(own, text))), bool(none)
    marked = join_checked(docs, again.df.withColumn("_again", F.lit(True)), ["doc_id"], "left", n)
    return marked.withColumn("_key", F.when(own.isNull() | F.col("_again"), F.xxhash64(own, text)).otherwise(own)).drop("_again"), True


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (sets of five-word shingles, similarity 0.8): the one with the smallest id.

    Rows without an id, and rows that share one but differ in text, are documents of their own: they are compared like any
    others, with a hash of id and text in the id's place. Of rows equal in id and text the least by all columns stays.
    Rows without words link with nothing and stay.
    """
    rows, repeated = keyed(docs)
    if repeated:
        rows = rows.groupBy("_key").agg(F.min(F.struct(*COLUMNS)).alias("_row")).select("_key", "_row.*")
    found = minhash.near_duplicates(rows, id_col="_key", words=5, percent=80)
    gone = write(found.filter("not kept").select("_key"), "gone")
    return join_checked(rows, gone.df, ["_key"], "left_anti", gone.df.count()).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the budgets of domains, languages and sources pay for as wholes.

    Rows without an id, or with a repeated one, take part with a hash of id and text in its place. Texts without words have
    no tokens to take and go; earlier stages leave none.
    """
    rows, _ = keyed(docs)
    taken = mixing.mix(rows, queries.mix_levels(), queries.MIX_WEIGHTS, MIX_SHARE, 1, queries.MIX_SEED, id_col="_key")
    ids = write(taken.filter("taken = doc_tokens").select("_key").distinct(), "mixed")
    return join_checked(rows, ids.df, ["_key"], "left_semi", ids.df.count()).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with the CRC-32 of each piece's ids."""
    return queries.digest_pieces(packing.pack(docs))


STAGES = [("language_id", language), ("toxicity", clean), ("near_duplicates", near_duplicates), ("mixing", mixed), ("packing", packed)]

#: Classifiers, signatures and packing are beyond SQL; each stage is tested against a brute-force version or labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the documents in sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    earlier = None
    for name, stage in STAGES:
        table = write(stage(spark, docs, sf_dir), name)
        if earlier:
            earlier.drop()
        earlier, docs = table, table.df
    return docs
