"""Chat formatting with Spark expressions only.

A conversation's rows become one training text:

    <|im_start|>ROLE<|im_sep|>TEXT<|im_part|>TEXT<|im_end|>\\n ...

Turn structs are collected, sorted by (turn, role, text) and adjacent rows of
one role are merged into one block by an array aggregation; ``<|im_part|>``
keeps the border between their texts, so nothing is lost. Control strings
inside roles and texts are escaped by a backslash behind their first character
(a string that already has backslashes there gets one more), which is undone
exactly by taking one away.

The loss mask lists the byte ranges of the formatted text (UTF-8) that hold
the texts of the trained role, in order.

A hot conversation is collected in two steps: rows meet per (conversation,
range of turns), and only finished blocks of each range meet per conversation.
A conversation's text is one row by nature, so it must fit a row (2 GB).

Defined results: a null text is empty, a null role is the empty role, a null
turn sorts first, equal turns sort by role and text, repeated rows are all
kept, rows with a null conversation id form one conversation. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkspark.llm.common import let, ref

START, SEP, PART, END = "<|im_start|>", "<|im_sep|>", "<|im_part|>", "<|im_end|>\n"

#: Control strings of this template and of common others. Fixed values; each
#: begins with < or [ and holds neither again.
CONTROL = ["<|im_start|>", "<|im_sep|>", "<|im_part|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]"]

#: Turn numbers per first-level group.
RANGE = 256


def _after(opener: str) -> str:
    return "|".join(c[1:].replace("|", r"\|").replace("]", r"\]") for c in CONTROL if c[0] == opener)


_CONTROL_ANY = rf"(<)(\\*)({_after('<')})|(\[)(\\*)({_after('[')})"
_CONTROL_ESCAPED = rf"(<)\\(\\*)({_after('<')})|(\[)\\(\\*)({_after('[')})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL_ANY, r"$1$4\\$2$5$3$6")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL_ESCAPED, "$1$4$2$5$3$6")


def _merged(turns: Column) -> Column:
    """Merge adjacent structs (role, parts) of one role.

    A block begins where the role changes; a block's parts are those up to the
    next beginning. Each part is copied once, so long runs stay linear.
    """

    def cut(t: Column) -> Column:
        begins = F.filter(F.transform(t, lambda x, i: F.when((i == 0) | (F.get(t, i - 1)["role"] != x["role"]), i)), lambda i: i.isNotNull())
        return let(
            begins,
            lambda b: F.transform(
                b,
                lambda at, k: F.struct(
                    F.get(t, at)["role"].alias("role"),
                    F.flatten(F.transform(F.slice(t, at + 1, F.coalesce(F.get(b, k + 1), F.size(t)) - at), lambda x: x["parts"])).alias("parts"),
                ),
            ),
        )

    return let(turns, cut)


def formatted(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` (string) and
    ``loss_mask`` (array of structs ``start``, ``length`` in bytes)."""
    rows = turns.select(
        ref(turns, conv_id).alias("conv_id"),
        ref(turns, turn).alias("turn"),
        F.coalesce(ref(turns, role), F.lit("")).alias("role"),
        F.coalesce(ref(turns, text), F.lit("")).alias("text"),
    )
    ranges = rows.groupBy("conv_id", F.floor(F.col("turn") / RANGE).alias("range")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    ranges = ranges.select(
        "conv_id",
        "range",
        _merged(F.transform("t", lambda x: F.struct(escape(x["role"]).alias("role"), F.array(escape(x["text"])).alias("parts")))).alias("b"),
    )
    convs = ranges.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("range", "b"))).alias("r"))
    blocks = convs.select("conv_id", _merged(F.flatten(F.transform("r", lambda x: x["b"]))).alias("b"))

    # Pieces of the text in order, each with whether it is under the loss.
    def pieces(block: Column) -> Column:
        head = F.struct(F.concat(F.lit(START), block["role"], F.lit(SEP)).alias("s"), F.lit(False).alias("loss"))
        parts = F.transform(
            block["parts"],
            lambda p, i: F.array(
                F.struct(F.when(i > 0, F.lit(PART)).otherwise(F.lit("")).alias("s"), F.lit(False).alias("loss")),
                F.struct(p.alias("s"), (block["role"] == trained).alias("loss")),
            ),
        )
        return F.concat(F.array(head), F.flatten(parts), F.array(F.struct(F.lit(END).alias("s"), F.lit(False).alias("loss"))))

    pieced = blocks.select("conv_id", F.flatten(F.transform("b", pieces)).alias("p"))
    return pieced.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: x["s"]), "").alias("formatted"),
        F.transform("p", lambda x: F.struct(F.octet_length(x["s"]).cast("long").alias("n"), x["loss"].alias("loss"))).alias("p"),
    ).select("conv_id", "formatted", _spans(F.col("p")).alias("loss_mask"))


def _spans(sizes: Column) -> Column:
    """Spans (start, length) of the pieces under the loss, by running sums in
    two levels: within chunks of 128 pieces, then over the chunks."""
    width = 128

    def running(values: Column) -> Column:
        # Exclusive running sums of an array of longs.
        return F.aggregate(
            values,
            F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("long").alias("sum")),
            lambda a, v: F.struct(F.concat(a["out"], F.array(a["sum"])).alias("out"), (a["sum"] + v).alias("sum")),
            lambda a: a["out"],
        )

    def chunked(p: Column) -> Column:
        count = F.ceil(F.size(p) / width).cast("int")
        return F.when(F.size(p) == 0, F.array().cast("array<array<struct<n:bigint,loss:boolean>>>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(p, k * width + 1, F.lit(width))))

    def total(chunk: Column) -> Column:
        return F.aggregate(chunk, F.lit(0).cast("long"), lambda a, x: a + x["n"])

    def spans(chunks: Column) -> Column:
        return let(
            running(F.transform(chunks, total)),
            lambda base: F.flatten(
                F.transform(
                    chunks,
                    lambda c, k: let(
                        running(F.transform(c, lambda x: x["n"])),
                        lambda inner: F.filter(
                            F.transform(c, lambda x, i: F.struct((F.get(base, k) + F.get(inner, i)).alias("start"), x["n"].alias("length"), x["loss"].alias("loss"))),
                            lambda s: s["loss"],
                        ),
                    ),
                )
            ),
        )

    picked = let(sizes, lambda p: let(chunked(p), spans))
    return F.transform(picked, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))


def parsed_turns(text: Column) -> Column:
    """The turns in a formatted text: array of structs (role, text)."""
    blocks = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        return let(
            F.split(F.substring(block, F.lit(len(START) + 1), F.char_length(block)), r"<\|im_sep\|>"),
            lambda rs: F.transform(
                F.split(F.get(rs, F.lit(1)), r"<\|im_part\|>"),
                lambda p: F.struct(unescape(F.get(rs, F.lit(0))).alias("role"), unescape(p).alias("text")),
            ),
        )

    return F.flatten(F.transform(blocks, turns))


def masked_text(text: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return let(
        text.cast("binary"),
        lambda raw: F.array_join(F.transform(mask, lambda m: unescape(F.substring(raw, (m["start"] + 1).cast("int"), m["length"].cast("int")).cast("string"))), ""),
    )
