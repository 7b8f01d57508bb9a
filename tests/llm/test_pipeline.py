"""The stages of the pipeline against brute-force versions of each on its own input."""

import hashlib
from collections import Counter

import corpus_pipeline
from evoria.llm import bpe

from .test_operators import assert_one_of_each, brute_kept, rows, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_in_turn(spark, tmp_path):
    table = [r[:5] for r in rows()] + [(1000 + i, f"token = '{'ab12' * 8}' " + " ".join(f"w{i}x{j}" for j in range(60 + i)), "en", "s1", 1) for i in range(5)]
    docs = spark.createDataFrame(table, SCHEMA)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.collect()
        if name == "quality_rules":
            assert Counter(after) <= Counter(before) and 40 < len(after) < len(before)
            assert all(len(words(r["text"])) >= 50 for r in after)
        if name == "near_duplicates":
            # five words and a similarity of 0.8
            assert Counter(after) <= Counter(before)
            assert_one_of_each(brute_kept([(r["doc_id"], r["text"]) for r in before]), [(r["doc_id"], r["text"]) for r in after])
        if name == "secret_scan":
            assert len(after) == len(before) and sum("[SECRET]" in r["text"] for r in after) == 5
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        if name == "source_mix":
            assert set(r["text"] for r in after) <= set(r["text"] for r in before)
            assert max(Counter(r["doc_id"] for r in after).values()) <= 3
        if name == "byte_pairs":
            own = bpe.Encoder(bpe.vocabulary_path())
            assert Counter((r["doc_id"], tuple(r["token_ids"]), r["ids_sha256"]) for r in after) == Counter((r["doc_id"], tuple(i := own.encode(r["text"])), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest()) for r in before)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"] and out.count() > 50


CLASHING = ("_row", "_text", "_id", "_key", "size", "source_size", "target", "_times", "_hash", "_best_id", "_best_hash", "h", "root", "wide", "n_words", "kept", "base_failed", "_found", "_spans", "_ends", "_chars", "_same", "_copy", "_all", "token_ids", "n_tokens", "law", "s")


def test_stages_with_clashing_columns_and_empty_tables(spark, tmp_path):
    words_ = [" ".join(f"v{i}x{j}" for j in range(60 + i)) for i in range(12)]
    table = [(i, t, ["en", None][i % 2], ["s1", None, "s2"][i % 3], 5, *["clash"] * len(CLASHING)) for i, t in enumerate([None, "", *words_, words_[0], words_[1] + f" token = '{'ab12' * 8}'"])] + [(None, words_[2] + " q", None, None, None, *[None] * len(CLASHING))]
    wide = spark.createDataFrame(table, SCHEMA + "".join(f", `{c}` string" for c in CLASHING))
    for start in (wide, wide.limit(0), wide.drop(*CLASHING)):
        docs = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == start.columns and out.dtypes == start.dtypes, name
            path = f"{tmp_path}/{id(start)}-{k}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert all(set(r[5:]) <= {"clash", None} for r in docs.collect())
        assert (docs.count() > 0) == (start is not wide and len(start.columns) == 5 or start is wide)
