import re

import pytest

from kinweave.llm import queries

SF = "/root/testdata/sf0.001"


def plan(frame, capsys):
    capsys.readouterr()
    frame.explain("formatted")
    return capsys.readouterr().out


@pytest.mark.parametrize("name, columns", [("op1_language_id", {"doc_id", "text"}), ("op4_token_counts", {"doc_id", "text"}), ("op5_secret_scan", {"doc_id", "text"}), ("op7_quality", {"doc_id", "text"}), ("op9_mixing", {"doc_id", "text", "source"})])
def test_only_needed_columns_are_read(spark, capsys, name, columns):
    said = plan(queries.queries()[name](spark, SF), capsys)
    read = [set(re.findall(r"(\w+):", x)) for x in re.findall(r"ReadSchema: struct<([^>]*)>", said)]
    assert columns in read and all(x <= columns | {"goal_source", "source_size", "target"} for x in read)


@pytest.mark.parametrize("name", ["op1_language_id", "op4_token_counts", "op5_secret_scan", "op7_quality"])
def test_per_document_operators_do_not_shuffle(spark, capsys, name):
    assert "Exchange" not in plan(queries.queries()[name](spark, SF), capsys)


def test_no_query_has_a_cross_join(spark, capsys):
    for name in ("op2_fingerprints", "op3_exact_top_k", "op6_near_duplicates", "op8_sharding", "op9_mixing", "op10_packing", "pipeline"):
        said = plan(queries.queries()[name](spark, SF), capsys)
        assert "CartesianProduct" not in said and "BroadcastNestedLoopJoin" not in said
