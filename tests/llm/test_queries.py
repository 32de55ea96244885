"""The training-data queries against SQL on whole small tables, and that all of them run."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import connect, rows, wanted  # noqa: E402

from strandline.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, data, name):
    assert rows(queries.QUERIES[name](spark, data)) == wanted(connect(data), queries.ORACLE[name])


def test_every_document_is_encoded_as_the_library_does(spark, data):
    from strandline.llm.encoding import VOCABULARIES, encoder

    plain = encoder("byte_bpe_50k", VOCABULARIES).encoding
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.QUERIES["p8_ids"](spark, data).collect()
    assert len(got) == len(texts)
    assert all(list(r.ids) == (plain.encode_ordinary(texts[r.doc_id]) if texts[r.doc_id] else []) for r in got)
    assert all(plain.decode(list(r.ids)) == texts[r.doc_id] for r in got if texts[r.doc_id])


def test_files_with_declarations_are_valid_and_handwritten(spark, data):
    units = spark.read.parquet(f"{data}/units.parquet").selectExpr("repo", "file_path as path").distinct()
    good = {r.file_id for r in spark.read.parquet(f"{data}/source_files.parquet").join(units, ["repo", "path"], "left_semi").select("file_id").collect()}
    assert not good & {r.file_id for r in queries.QUERIES["p2_found"](spark, data).collect()}
    assert not good & {r.file_id for r in queries.QUERIES["p4_found"](spark, data).collect()}


def test_mix_meets_its_targets(spark, data):
    shares = [r for r in queries.QUERIES["p9_shares"](spark, data).collect()]
    there = sum(r.target_share for r in shares if r.tokens_available)
    assert all(r.passes <= r.max_repeats for r in shares)
    assert all(abs(r.actual_share - r.target_share / there) < 0.05 for r in shares if r.tokens_available)
