"""Cases that every operator defines: empty tables, clashing names, very long texts."""

import corpus_pipeline
import public_tokenizers as P
import pytest
from leadloom.llm import bpe, decontam, exact, line_dedup, near_copies, near_dups, pii, secrets, substring, token_files

LONG = " ".join(f"word{k % 977}" for k in range(200_000))
KIND = "doc_id long, text string"
CLASH = [f"{k} AS {name}" for k, name in enumerate(["r", "words", "key", "shard", "spans", "doc", "row_key", "at", "ids", "n", "group", "marked", "similarity", "keep_id", "`__lines`", "`__row`", "`__text_key`", "`__losing`", "`__one`", "`__contamination`"])]
BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def operators(spark):
    items = spark.createDataFrame([(1, "an item of the benchmark that nobody has in his text at all")], "item_id long, text string")
    return {
        "secrets": secrets.secret_spans, "simhash": near_dups.simhash_components, "substring": lambda d: substring.substring_dedup(d, digests=True), "lines": line_dedup.line_dedup, "passages": line_dedup.without_repeats,
        "decontam": lambda d: decontam.contamination(d, items), "exact": exact.exact_dedup, "bpe": lambda d: bpe.encode_decode(d, BYTES, digests=True), "files": lambda d: token_files.round_trip(d, WORDS), "pii": pii.personal_spans,
        "near": near_copies.near_dedup,
    }


NAMES = ["secrets", "simhash", "substring", "lines", "passages", "decontam", "exact", "bpe", "files", "pii", "near"]


@pytest.mark.parametrize("name", NAMES)
def test_clashing_names_nulls_and_empty_tables(spark, name):
    run = operators(spark)[name]
    rows = [(1, "one two three"), (2, None), (None, "x"), (3, ""), (3, "")]
    plain = spark.createDataFrame(rows, KIND)
    wide = plain.selectExpr("*", *CLASH)
    own = run(plain).columns if name not in ("passages", "near") else ["doc_id", "text"]
    got, want = run(wide).select(*own).collect(), run(plain).select(*own).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and (len(got) == 5 or name == "near")
    empty = run(wide.limit(0))
    assert empty.count() == 0 and set(own) <= set(empty.columns)


@pytest.mark.parametrize("name", NAMES)
def test_very_long_texts(spark, name):
    """One text of 200,000 words twice, among short ones."""
    got = operators(spark)[name](spark.createDataFrame([(1, LONG), (2, LONG), (3, "short")], KIND))
    assert got.count() == (2 if name == "near" else 3)


def test_the_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
