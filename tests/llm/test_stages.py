"""Every pipeline stage alone: nulls, repeated and empty rows, empty tables, columns with names used inside."""

import collections
import json
import random

import corpus_pipeline
import public_tokenizers
import pytest
from graderoom.llm.decontaminate import without_leaks
from graderoom.llm.mixing import mix_sources
from graderoom.llm.tokens import encode_documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF_SMALL = "/root/testdata/sf0.001"
CLASHES = ("copy", "n_copies", "shuffle_key", "file_name", "row_index", "kept", "distance", "centre", "node", "w_t", "k", "g")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 90), "en", "a") for i in range(60)]
    twice = prose(rng, 120)
    rows += [(100, twice, "en", "b"), (101, twice, "de", None), (None, prose(rng, 80), None, "a"), (None, prose(rng, 70), "en", "a"),
             (7, prose(rng, 75), "en", "b"), (200, None, "en", "a"), (201, "", None, None), (202, "one", "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    return docs


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, odd, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    path = str(tmp_path / "docs")
    odd.write.parquet(path)
    out = stage(spark, spark.read.parquet(path), SF_SMALL)
    rows = out.collect()
    if name == "token_output":
        assert len(rows) == odd.count() and sum(r.doc_id is None for r in rows) == 2
        return
    assert out.columns == odd.columns
    assert all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    given = {(r.doc_id, r.text) for r in odd.collect()}
    left = {(r.doc_id, r.text) for r in rows}
    assert left <= given
    if name == "quality_rules":
        assert len(left) >= len(given) - 4 and not any(t is None or len(t) < 50 for _, t in left)
    if name == "near_dedup":
        assert given - left == {(101, next(r.text for r in rows if r.doc_id == 100))}
    if name == "decontaminate":
        assert left == given


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_an_empty_table(spark, odd, tmp_path, name):
    path = str(tmp_path / "docs")
    odd.limit(0).write.parquet(path)
    assert dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(path), SF_SMALL).count() == 0


def test_documents_without_a_key_are_drawn_one_by_one(spark):
    docs = spark.createDataFrame([(None, f"text {i}", "s") for i in range(400)], "doc_id long, text string, source string")
    for seed in (1, 2):
        copies = collections.Counter(r.text for r in mix_sources(docs, seed=seed).collect())
        assert 200 < len(copies) < 320 and 300 < sum(copies.values()) < 500


def test_clean_text_that_shares_an_id_with_a_leak_stays(spark):
    rng = random.Random(9)
    item = prose(rng, 40)
    clean = prose(rng, 60)
    docs = spark.createDataFrame([(1, "see " + item), (1, clean), (None, item), (None, clean), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(0, item)], "item_id long, text string")
    left = collections.Counter(map(tuple, without_leaks(docs, items).collect()))
    assert left == collections.Counter([(1, clean), (None, clean), (2, None)])


def test_tokenizer_without_its_split_pattern(spark, tmp_path):
    plain = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    plain["pre_tokenizer"]["use_regex"] = False
    path = str(tmp_path / "plain.json")
    json.dump(plain, open(path, "w"))
    texts = ["the same words and the same words", "a  b\n\nc, d's", "end of it all 123"]
    got = {r.doc_id: r.n_tokens for r in encode_documents(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    tokenizer = Tokenizer.from_file(path)
    assert got == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
