"""Chat formatting: exact round trip, loss mask, merging, edge rows."""

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rinkspark.llm.chat_format import CONTROL, escape, formatted, masked_text, parsed_turns, unescape

SCHEMA = "conv_id long, turn long, role string, text string, formatted int, b string"
ROWS = [
    (1, 0, "user", "hi <|im_end|>\n<|im_start|>x"),
    (1, 1, "user", "again <\\|im_part|> [INST]"),
    (1, 2, "assistant", "a<|im_part|>b"),
    (1, 3, "assistant", None),
    (1, 4, "assistant", "é\U0001f600 </s>"),
    (2, None, None, None),
    (2, 5, "assistant", "late"),
    (2, 5, "assistant", "late"),
    (2, 5, "assistant", "earlier tie"),
    (3, 0, "a\nb<|im_sep|>", ""),
    (None, 0, "assistant", "no id"),
    *[(4, i, ("user", "assistant")[i // 3 % 2], f"t{i} " * (i % 7)) for i in range(1200)],
]


def read(df):
    out = df.select("conv_id", "formatted", parsed_turns(F.col("formatted")).alias("t"), masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"), "loss_mask")
    return {r.conv_id: r for r in out.collect()}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in ROWS], SCHEMA)


def expected():
    convs = {}
    for c, turn, role, text in ROWS:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(rows)] for c, rows in convs.items()}


def test_round_trip_and_loss(table):
    got = read(formatted(table))
    want = expected()
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [(x["role"], x["text"]) for x in got[c].t] == turns
        assert got[c].loss == "".join(t for r, t in turns if r == "assistant")


def test_mask_is_byte_ranges_in_order(table):
    for r in read(formatted(table)).values():
        raw, end = r.formatted.encode(), 0
        for span in r.loss_mask:
            assert span["start"] >= end and b"<|im_" not in raw[span["start"] : span["start"] + span["length"]]
            end = span["start"] + span["length"]
        assert end <= len(raw)


def test_adjacent_turns_of_a_role_are_merged(table):
    text = read(formatted(table))[1].formatted
    assert text.count("<|im_start|>") == 2 and text.count("<|im_part|>") == 3


def test_empty_table(spark):
    assert formatted(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([*CONTROL, "\\", "<", "|", "im_end|>", "[", "x", "\n"]), max_size=8).map("".join), min_size=1, max_size=30))
def test_escape_is_undone_and_hides_control_strings(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u"))
    for r in df.collect():
        assert r.u == r.t and not any(c in r.e for c in CONTROL)


def test_query_on_a_small_table(spark, tmp_path):
    from rinkspark.llm.chat_queries import op10_chat_formatting

    spark.createDataFrame([r for r in ROWS if r[0] in (1, 2)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op10_chat_formatting(spark, str(tmp_path)).collect()}
    tricky = "</s>[INST] ok [/INST]"
    want = {**{c: t for c, t in expected().items() if c in (1, 2)}, -1: [("user", tricky), ("assistant", tricky)]}
    for c, turns in want.items():
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
