"""Operators on inputs that the small tables lack: nothing may be left out."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from evidentia.llm import embedding_dedup, packing, queries

MARKED = ["hello <|endoftext|> world<|endoftext|>", "<|endoftext|>", "a  <|endoftext|><|endoftext|>  b", "<|endoftext| >", "<|endoftext|>\n\nx <|<|endoftext|>|>", "plain text"]


def test_special_tokens_are_those_of_the_tokenizer(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert t.encode(MARKED[0], add_special_tokens=False).ids == [31373, 220, 50256, 995, 50256]
    docs = spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string").coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for got in (queries.op9_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, "")):
        pieces = {r["doc_id"]: [] for r in got.collect()}
        for r in got.collect():
            pieces[r["doc_id"]].append(r)
        for i, text in enumerate(MARKED):
            ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
            assert {r["doc_tokens"] for r in pieces[i]} == {len(ids)}, text
            for r in pieces[i]:
                assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()), text


@pytest.mark.parametrize("share", [2, 3, 10])
def test_pairs_of_a_hot_group_meet_in_a_leaf(share):
    # a part of all vectors scattered about one centre so that pairs lie near cosine 0.95
    random = np.random.default_rng(1)
    x = random.normal(size=(6000, 64))
    hot = len(x) // share
    centre = x[0] / np.linalg.norm(x[0])
    x[:hot] = centre + random.normal(size=(hot, 64)) * np.sqrt((1 / 0.95 - 1) / 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, code = embedding_dedup.plant(x, len(x), 0.95, leaf=16).leaves(x)
    near = np.triu(x @ x.T >= 0.95, 1)
    links, largest = near.sum(), 0
    for c in np.unique(code):
        leaf = row[code == c]
        near[np.ix_(leaf, leaf)] = False
        largest = max(largest, len(leaf))
    assert links > 50_000 and near.sum() == 0
    assert largest < 1.5 * hot + 500  # other vectors are still dealt apart
