"""Registered queries of the subpackage: contract columns, DuckDB oracles."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from rinkspark.llm.queries import ORACLES, QUERIES

SF = os.environ.get("RINKSPARK_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

COLUMNS = {
    "op1": ["page_id", "host", "path", "rule", "verdict"],
    "op2": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op3": ["doc_id", "text"],
    "op4": ["doc_id", "class_id"],
    "op5": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op6": ["page_id", "url", "text", "n_chars"],
    "op7": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op9": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op10": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op11": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op12": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op13": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
}


def test_all_operators_and_the_pipeline_are_registered():
    names = E.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_has_its_columns_and_matches_its_oracle(spark, name):
    df = QUERIES[name](spark, SF)
    assert set(COLUMNS[name.split("_")[0]]) <= set(df.columns)
    rows = df.collect()
    assert len(rows) > 0
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        cur = con.execute(ORACLES[name])
        cols = [c[0] for c in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert sorted(tuple(r[c] for c in cols) for r in rows) == sorted(cur.fetchall())
