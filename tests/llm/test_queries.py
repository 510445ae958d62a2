from clauseforge.llm import queries

COLUMNS = {
    "p1_found": ["doc_id", "char_start", "char_end"], "p2_found": ["model", "key_a", "key_b"], "p3_found": ["qid", "span_index"], "p4_found": ["block_id", "sent_start", "sent_end"],
    "p5_found": ["request_id", "defect"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "band"],
}


def test_names_and_columns(spark):
    from pathlib import Path

    import pytest

    assert set(COLUMNS) <= set(queries.QUERIES)
    d = "/root/testdata/sf0.001"
    if not Path(d).exists():
        pytest.skip("no test tables here")
    for name, columns in COLUMNS.items():
        df = queries.QUERIES[name](spark, d)
        rows = df.collect()
        assert df.columns == columns and len(rows) == len(set(rows)), name
