"""Personal data by bootstrapped contextual extraction.

Base: emails, IPv4 addresses, card and phone numbers by fixed expressions and
checks (leftmost, not overlapping per kind). They are the seeds.

1. One pass over the texts finds the base spans and, beside them, candidates:
   other tokens with a digit or an at sign (neighbouring ones of digits and
   phone punctuation are one). Each occurrence gives three lexical patterns:
   the word before it, the two words before it, and the words on both sides.
2. Patterns and instances (distinct strings) are a bipartite graph. A pattern's
   score for a kind is the confidence of its instances of that kind over the
   number of its instances plus ``SMOOTHING``, where candidates that may be of
   the kind but are not known to be count ``UNKNOWN`` each; all others, numbers
   that are no identifier included, count fully against it. It needs
   ``MIN_SUPPORT`` instances.
3. A candidate's confidence for a kind it may be (an at sign for an email,
   digits enough and no letters for a number) is one less the product of one
   less the scores of its good patterns. From ``ACCEPT`` on it is of that kind
   and adds to its patterns' scores in the next round, until a round changes
   nothing or ``ROUNDS`` are over.
4. All occurrences of accepted instances become spans, beside the base ones.

Edges are distinct (pattern, instance) pairs, so copies of a document add
nothing. Scores are sums per pattern and per instance, combined map-side; a
frequent pattern or instance is one row per task. Only identifiers with their
contexts are shuffled, texts never. Every round is written to the shared
folder. No state of it passes the driver but a row count.

Defined results: null and empty texts have no spans. Offsets are code points,
ends exclusive. Added spans do not touch base ones; every row is judged on its
own, whether its id is null or repeated. Tokens of more than 254 code points
(the longest address) are no candidates. Context words are those within 80
code points of the occurrence.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinkspark.llm.common import free_name, map_texts, ref, staged

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
SMOOTHING = 1.0
UNKNOWN = 0.25
MIN_SUPPORT = 3.0
MIN_PATTERN = 0.7
ACCEPT = 0.9
ROUNDS = 4
MAX_TOKEN = 254
CONTEXT = 80

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins where its digits begin, since a shorter start would fail too.
_IP = re.compile(r"(?<![0-9])[0-9]++((?:\.[0-9]+){3})")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HIT = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_NUMBER = re.compile(r"[0-9().+/-]+\Z")
_LETTER = re.compile(r"[^\W\d_]")
_ADDRESS = re.compile(r"[0-9a-f]*(?:[.:][0-9a-f]*){3,}\Z")
_EDGES = ".,;:!?()[]{}<>\"'*%&$#=|"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base matches, by kind, then start."""
    out = []
    if _HIT.search(text) is None and "@" not in text:
        return out
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            out.append((EMAIL, start, done))
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((IP, m.start(), m.end()))
    for kind, found, least, most in ((CARD, _CARD, 13, 19), (PHONE, _PHONE, 9, 15)):
        for m in found.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if least <= len(digits) <= most and (kind == PHONE or luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return out


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of tokens with a digit or an at sign that touch no base span."""
    tokens: list[list[int]] = []
    hit = _HIT.search(text)
    while hit:
        start, last = hit.start(), tokens[-1][1] if tokens else 0
        while start > last and not text[start - 1].isspace():
            start -= 1
        stop = _SPACE.search(text, hit.end())
        end = stop.start() if stop else len(text)
        tokens.append([start, end])
        hit = _HIT.search(text, end)
    spans = sorted((s, e) for _, s, e in taken)
    out: list[tuple[int, int]] = []
    number_before, k = False, 0
    for start, end in tokens:
        while k < len(spans) and spans[k][1] < start:
            k += 1
        if any(s <= end and start <= e for s, e in spans[k:] if s <= end) or end - start > MAX_TOKEN:
            number_before = False
            continue
        a, b = start, end
        while a < b and text[a] in _EDGES and text[a] != "(":
            a += 1
        while a < b and text[b - 1] in _EDGES:
            b -= 1
        if a == b:
            continue
        if b < end and text[b] == ")" and "(" in text[a:b]:
            b += 1
        number = _NUMBER.match(text, a, b) is not None
        if number and number_before and a == out[-1][1] + 1 and b - out[-1][0] <= MAX_TOKEN:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
        number_before = number and b == end
    return out


def may_be(instance: str) -> int:
    """Bits of the kinds that a candidate may be."""
    digits = len(_NOT_DIGIT.sub("", instance))
    letters = _LETTER.search(instance) is not None
    out = (1 << EMAIL) if "@" in instance[1:-1] else 0
    if _ADDRESS.match(instance) and digits:
        out |= 1 << IP
    if not letters and "@" not in instance and 12 <= digits <= 19:
        out |= 1 << CARD
    if not letters and "@" not in instance and 7 <= digits <= 15:
        out |= 1 << PHONE
    return out


def _word(raw: str) -> str:
    return re.sub(r"[0-9]", "0", raw.lower()).strip(".,;!?()[]{}<>\"'*%&$|")


def patterns(text: str, start: int, end: int) -> list[str]:
    before = [w for w in map(_word, text[max(0, start - CONTEXT) : start].split()) if w][-2:]
    after = [w for w in map(_word, text[end : end + CONTEXT].split()) if w][:1]
    one, nxt = before[-1] if before else "^", after[0] if after else "$"
    return [f"1 {one}", f"2 {' '.join(before) or '^'}", f"3 {one} _ {nxt}"]


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_FOUND = pa.struct([("instance", pa.string()), ("kind", pa.int32()), ("may_be", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("patterns", pa.list_(pa.string()))])
_SPAN_SQL = "array<struct<kind:int,start:int,end:int>>"
_FOUND_SQL = "array<struct<instance:string,kind:int,may_be:int,start:int,end:int,patterns:array<string>>>"


def _extractor() -> Callable[[pa.Array], Sequence[pa.Array]]:
    def extract(texts: pa.Array) -> Sequence[pa.Array]:
        base, found = [], []
        for text in texts.to_pylist():
            own = base_spans(text)
            rows = [(text[s:e].lower(), kind, 0, s, e) for kind, s, e in own]
            rows += [(x := text[s:e].lower(), -1, may_be(x), s, e) for s, e in candidates(text, own)]
            base.append([{"kind": kind, "start": s, "end": e} for kind, s, e in own])
            found.append([{"instance": x, "kind": kind, "may_be": m, "start": s, "end": e, "patterns": patterns(text, s, e)} for x, kind, m, s, e in rows])
        return [pa.array(base, pa.list_(_SPAN)), pa.array(found, pa.list_(_FOUND))]

    return extract


def scored(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Rows (instance, kind, confidence) of the candidates that ``edges``
    (distinct instance, kind, may_be, pattern; kind -1 for a candidate) accept."""
    kinds = range(len(KINDS))
    may = lambda k: F.expr(f"CAST(kind = -1 AND shiftright(may_be, {k}) % 2 = 1 AS DOUBLE)")
    counts = F.array(*[F.struct(F.lit(k).alias("kind"), F.sum((F.col("kind") == k).cast("double")).alias("positive"), F.sum(may(k)).alias("unknown")) for k in kinds])
    known = edges.groupBy("pattern").agg(F.count("*").alias("degree"), counts.alias("counts"))
    open_edges = staged(edges.filter("kind = -1 AND may_be > 0").select("instance", "may_be", "pattern"), "candidate-edges")
    known = staged(known.join(open_edges.select("pattern").distinct(), "pattern", "left_semi"), "patterns")
    accepted, size = None, 0
    for n in range(rounds):
        seen = known.select("pattern", "degree", F.inline("counts"))
        if accepted is not None:
            added = open_edges.join(accepted, "instance").groupBy("pattern", "kind").agg(F.sum("confidence").alias("more"), F.count("*").alias("new"))
            seen = seen.join(added, ["pattern", "kind"], "left").na.fill(0, ["more", "new"])
            seen = seen.withColumns({"positive": F.col("positive") + F.col("more"), "unknown": F.col("unknown") - F.col("new")})
        weight = F.col("degree") - (1 - UNKNOWN) * F.col("unknown") + SMOOTHING
        good = seen.withColumn("score", F.col("positive") / weight)
        good = good.filter((F.col("positive") >= MIN_SUPPORT) & (F.col("score") >= MIN_PATTERN)).select("pattern", "kind", "score")
        hits = open_edges.join(good, "pattern").filter(F.expr("shiftright(may_be, kind) % 2 = 1"))
        # Sums in whole millionths: the same in any order.
        doubt = F.sum(F.round(F.log1p(-F.col("score")) * 1e6).cast("long"))
        judged = hits.groupBy("instance", "kind").agg((F.lit(1.0) - F.exp(doubt / 1e6)).alias("confidence")).filter(F.col("confidence") >= ACCEPT)
        best = judged.groupBy("instance").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("minus"))).alias("b"))
        accepted = staged(best.select("instance", (-F.col("b.minus")).alias("kind"), F.round("b.confidence", 6).alias("confidence")), f"accepted-{n}")
        before, size = size, accepted.count()
        if size == before:
            break
    return accepted


def with_private(docs: DataFrame, text_col: str = "text", keep: Sequence[str] | None = None, rounds: int = ROUNDS) -> tuple[DataFrame, str, str]:
    """The columns ``keep`` (all by default) of ``docs`` with two more, and
    their names: base spans and all spans (arrays of structs kind, start, end;
    kinds count as in ``KINDS``), each by kind, then start."""
    kept = list(docs.columns if keep is None else keep)
    base, found, row, added = (free_name(docs, c) for c in ("_base", "_found", "_row", "_added"))
    new = T.StructType([T.StructField(base, T._parse_datatype_string(_SPAN_SQL)), T.StructField(found, T._parse_datatype_string(_FOUND_SQL))])
    rows = staged(map_texts(docs, text_col, _extractor, new, kept).withColumn(row, F.monotonically_increasing_id()), "identifiers")
    seen = rows.select(F.col(row).alias("row"), F.inline(found))
    edges = seen.select("instance", "kind", "may_be", F.explode("patterns").alias("pattern")).distinct()
    accepted = scored(staged(edges, "pattern-edges"), rounds)
    spans = seen.filter("kind = -1").drop("kind").join(accepted, "instance").groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("kind", "start", "end")).alias(added))
    out = rows.join(spans, row, "left")
    every = F.sort_array(F.concat(F.col(base), F.coalesce(F.col(added), F.array().cast(_SPAN_SQL))))
    return out.select(*[ref(out, c) for c in kept], F.col(base), every.alias(found)), base, found


def spelled(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; a span that
    begins inside another one goes with it."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus"), s["kind"].alias("kind"))))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, x: F.when(x["start"] < s["at"], F.struct(F.greatest(s["at"], -x["minus"]).alias("at"), s["out"].alias("out"))).otherwise(
        F.struct((-x["minus"]).alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.get(names, x["kind"])).alias("out"))
    )
    return F.aggregate(by_place, state, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))
