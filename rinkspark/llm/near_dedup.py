"""Near-duplicate classes by Order MinHash and banded alignment.

A document is the sequence of its occurrence-labelled five-word shingles (the
same shingle's first, second, ... occurrence are different labels). Two
documents are near duplicates if the longest sequence of labels that both hold
in the same order has at least 0.8 of the size of the union of their labels.
Unlike set overlap this falls when text is moved, as edit similarity does.

1. Documents of the same words are one node, the least id among them.
2. Order MinHash: for each of 32 hash functions the 6 labels of least hash, in
   text order, are one key. A pair at exactly 0.8 shares a given key with about
   0.8^6 and misses all 32 with 0.0004 at 25 labels, 0.0001 at 60 and more. Short documents (at most 24 shingles)
   get exact keys instead: at 0.8 they differ in 5 shingles at most, which
   touch 5 groups of shingles at most if these are dealt by hash; the sequences
   of the groups left are equal and are compared by digest.
3. Every node is compared with the leader of each of its buckets, the node
   whose buckets hold the most nodes in all: among copies of one original that
   is the original, or what is nearest to it.
4. Nodes of a leader that are not in its component then (strays) are compared
   with all nodes of that leader outside their own component, in blocks: a
   block's labels are held as an inverted index, strays stream past it, and only
   links are written. So no candidate pair across components is left out,
   while members of one component (copies of copies) are not expanded into
   pairs, and pairs that fail are never rows.
5. A comparison is a banded alignment: shared labels within the band of
   offsets that 0.8 allows are chained in order (longest increasing chain).
   Members stream past their leader, which is held alone; a leader with many
   members is repeated for each salt, so no group has to fit a task.

Defined results: a document without words is a class of its own, unless its
text (not empty) occurs elsewhere exactly; null and empty texts and rows
without an id are alone. Rows that repeat an id are one document, compared by
its greatest text. The class id
is the least id of the class. Word comparison ignores the case of A-Z and
punctuation. Other columns are ignored here, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from functools import cache
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinkspark.llm.common import free_name, map_texts, ref, ship_package, staged
from rinkspark.llm.components import components
from rinkspark.llm.leaders import compare_with_leaders, join_salted, large_groups
from rinkspark.operators.joins import join_small
from rinkspark.llm.text_arrays import mixed, ragged, span_hashes, utf8, words

SHINGLE = 5
SIMILARITY = 0.8
FUNCTIONS = 32
PICKED = 6
#: Up to this many shingles, exact keys; from LONG_FROM on, sketches.
#: A pair at 0.8 has both below the first or both above the second bound.
SHORT_TO = 24
LONG_FROM = 20
#: Dealings of a short document's labels to groups, the last for all that is left.
DEALINGS = 8
#: Documents whose labels a task holds while strays stream past.
BLOCK_ROWS = 256

_MULTIPLIERS = mixed(np.arange(1, FUNCTIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_STEP = np.uint64(0x100000001B3)
_SHIFTS = np.arange(DEALINGS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def shingles(keys: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five word keys; of all words if they are fewer."""
    n = len(keys)
    width = min(SHINGLE, n)
    if n == 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        h = mixed(h * _STEP + keys[k : n - width + 1 + k].astype(np.uint64))
    return h


def labelled(h: np.ndarray) -> np.ndarray:
    """Make equal entries differ by the number of their occurrence."""
    order = np.argsort(h, kind="stable")
    run = np.ones(len(h), bool)
    run[1:] = h[order][1:] != h[order][:-1]
    first = np.flatnonzero(run)
    occurrence = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    out = np.empty_like(h)
    out[order] = mixed(h[order] + occurrence.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


@cache
def _choices(groups: int, kept: int) -> np.ndarray:
    """One row per choice of ``kept`` groups: which groups it holds."""
    rows = list(combinations(range(groups), kept))
    out = np.zeros((len(rows), groups), bool)
    for row, chosen in zip(out, rows, strict=True):
        row[list(chosen)] = True
    return out


def short_keys(labels: np.ndarray) -> np.ndarray:
    """Keys of which two short sequences at 0.8 share one at least.

    Sequences of n and m labels at 0.8 have d = (n + m) // 9 labels at most
    outside their alignment. Of d + k groups of labels, dealt by hash, k are
    untouched: equal in both, in the same order. So a key is the sequence of k
    groups, for every choice of them and every d that n allows. Where a choice
    holds no label, a next dealing does for it."""
    n, out = len(labels), []
    for d in sorted({(n + m) // 9 for m in range(-(-4 * n // 5), min(SHORT_TO, 5 * n // 4) + 1)}):
        kept = 1 if d in (0, 3) else 2
        choices = _choices(d + kept, kept)
        for dealing in range(DEALINGS):
            group = (mixed(labels + _SHIFTS[dealing]) >> np.uint64(33)) % np.uint64(d + kept)
            inside = choices[:, group.astype(np.int64)]
            key = np.arange(len(choices), dtype=np.uint64) + np.uint64(64 * (DEALINGS * d + dealing) + 1)
            for at in range(n):
                key = np.where(inside[:, at], mixed(key * _STEP + labels[at : at + 1]), key)
            some = inside.any(axis=1)
            out.append(mixed(key[some | (dealing == DEALINGS - 1)]))
            if some.all():
                break
    return np.concatenate(out)


def bucket_keys(labels: np.ndarray) -> np.ndarray:
    """Bucket keys of a document as signed 64-bit integers."""
    n, out = len(labels), []
    if 0 < n <= SHORT_TO:
        out.append(short_keys(labels))
    if n >= LONG_FROM:
        hashed = labels[:, None] * _MULTIPLIERS
        hashed ^= hashed >> np.uint64(32)
        hashed *= np.uint64(0xBF58476D1CE4E5B9)
        least = np.sort(np.argpartition(hashed, PICKED - 1, axis=0)[:PICKED], axis=0)
        key = np.arange(FUNCTIONS, dtype=np.uint64) + np.uint64(1)
        for row in least:
            key = mixed(key * _STEP + labels[row])
        out.append(key)
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _increasing(values: np.ndarray) -> int:
    """Length of the longest increasing chain."""
    if len(values) < 2 or (np.diff(values) > 0).all():
        return len(values)
    tails: list[int] = []
    for v in values.tolist():
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
        else:
            tails[k] = v
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Ordered similarity of two label sequences by banded alignment; 0 if it
    is below ``least``. Sequences at ``least`` differ in at most
    (1 - least) / (1 + least) of both sizes, which bounds the offset of any
    two aligned labels, so the band loses nothing."""
    total = len(a) + len(b)
    band = int(total * (1 - least) / (1 + least) + 1e-9)
    if total == 0 or abs(len(a) - len(b)) > band:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    inside = np.abs(i - j) <= band
    i, j = i[inside], j[inside]
    if 2 * len(i) < total - band:
        return 0.0
    shared = _increasing(j[np.argsort(i)])
    value = shared / (total - shared)
    return value if value >= least else 0.0


def _sketcher() -> Callable[[pa.Array], Sequence[pa.Array]]:
    def sketch(texts: pa.Array) -> Sequence[pa.Array]:
        data, begins = utf8(texts)
        low, starts, ends, first = words(data, begins)
        keys = span_hashes(low, starts, ends)
        digests, buckets = [], []
        for i in range(len(texts)):
            own = keys[first[i] : first[i + 1]]
            raw = own.tobytes() if len(own) else data[begins[i] : begins[i + 1]].tobytes()
            digests.append(blake2b(raw, digest_size=16, person=b"words" if len(own) else b"text").digest() if raw else None)
            buckets.append(bucket_keys(labelled(shingles(own))) if len(own) else np.zeros(0, np.int64))
        sizes = np.cumsum([0] + [len(b) for b in buckets]).astype(np.int32)
        return [pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(buckets) if buckets else np.zeros(0, np.int64)))]

    return sketch


def _word_keys() -> Callable[[pa.Array], Sequence[pa.Array]]:
    def run(texts: pa.Array) -> Sequence[pa.Array]:
        low, starts, ends, first = words(*utf8(texts))
        keys = span_hashes(low, starts, ends)
        return [pa.array([keys[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())]

    return run


def verified(pairs: DataFrame, payload: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) that are near duplicates. ``payload`` (id, data) holds
    the word keys of every id in ``pairs``."""

    def labels(raw: bytes) -> np.ndarray:
        return labelled(shingles(np.frombuffer(raw, np.uint64)))

    def compare(a: int, held: np.ndarray, b: int, raw: bytes) -> Iterator[tuple]:
        if similarity(held, labels(raw), least) > 0:
            yield a, b

    return compare_with_leaders(pairs, payload, labels, compare, "a bigint, b bigint")


class Block:
    """Label sequences of some documents with an inverted index, to find those
    that may be similar to a given one without comparing with each."""

    def __init__(self, rows: Sequence[tuple[int, int, np.ndarray]]):
        self.rows = rows  # id, component, labels
        labels = np.concatenate([x for _, _, x in rows])
        owner = np.repeat(np.arange(len(rows)), [len(x) for _, _, x in rows])
        order = np.argsort(labels, kind="stable")
        self.owner = owner[order]
        self.labels, first = np.unique(labels[order], return_index=True)
        self.begins = np.append(first, len(labels))
        self.sizes = np.array([len(x) for _, _, x in rows])
        self.components = np.array([c for _, c, _ in rows])

    def similar(self, component: int, own: np.ndarray, least: float) -> Iterator[int]:
        """Ids of similar rows of other components."""
        at = np.searchsorted(self.labels, own)
        at = at[at < len(self.labels)]
        at = at[np.isin(self.labels[at], own)]
        shared = np.bincount(ragged(self.owner, self.begins, np.unique(at)), minlength=len(self.rows))
        enough = (shared >= least * (self.sizes + len(own) - shared) - 1e-9) & (self.components != component)
        for k in np.flatnonzero(enough).tolist():
            if similarity(self.rows[k][2], own, least) > 0:
                yield self.rows[k][0]


def across_components(pairs: DataFrame, inside: DataFrame, payload: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between nodes of one leader in different components.

    A leader's nodes are dealt to blocks of about ``BLOCK_ROWS``; its strays
    (nodes outside its own component) go to each of them."""
    ship_package(pairs.sparkSession)
    members = pairs.select("a", "b").union(pairs.select("a", F.col("a").alias("b"))).distinct()
    placed = members.join(inside.withColumnRenamed("node", "b"), "b", "left").select("a", "b", F.coalesce("component", "b").alias("component"))
    main = placed.filter("a = b").select("a", F.col("component").alias("main"))
    large = staged(large_groups(members, "a"), "large-leaders")
    placed = staged(join_salted(placed, main, large, "a", "b"), "placed")
    mixed = placed.groupBy("a").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"), F.max((F.col("component") != F.col("main")).cast("int")).alias("strays")).filter("strays = 1").drop("strays")
    open_rows = join_salted(placed, mixed, large, "a", "b")
    held = open_rows.select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("role"), "b", "component")
    stray = open_rows.filter("component <> main").select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "b", "component")
    rows = held.union(stray).join(payload.withColumnRenamed("id", "b"), "b")
    rows = rows.repartition("a", "block").sortWithinPartitions("a", "block", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, waiting, block = None, [], None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, part, role, b, component, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "block", "role", "b", "component", "data")), strict=True):
                if (a, part) != where:
                    where, waiting, block = (a, part), [], None
                own = labelled(shingles(np.frombuffer(raw, np.uint64)))
                if role == 0:
                    waiting.append((b, component, own))
                elif waiting:
                    block = block or Block(waiting)
                    found.extend((b, other) for other in block.similar(component, own, least))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, class_id), one per distinct non-null id."""
    ids = docs.select(ref(docs, id_col).cast("long").alias("id"), ref(docs, text_col).alias("text")).filter("id IS NOT NULL")
    sketch = map_texts(ids, "text", _sketcher, T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))]), ["id"])
    sketch = staged(sketch, "sketches")

    # Documents of the same words: one node.
    nodes = sketch.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("node"), F.first("keys").alias("keys"))
    buckets = staged(nodes.select("node", F.explode("keys").alias("key")), "buckets")
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = staged(buckets.join(sizes, "key"), "shared-buckets")
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    lead = shared.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("l"))
    lead = lead.select("key", (-F.col("l.minus")).alias("leader"))
    pairs = staged(shared.join(lead, "key").filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs")

    involved = shared.select(F.col("node").alias("id")).distinct()
    texts = ids.join(involved, "id").groupBy("id").agg(F.max("text").alias("text"))
    payload = staged(map_texts(texts, "text", _word_keys, T.StructType([T.StructField("data", T.BinaryType())]), ["id"]), "word-keys")
    links = staged(verified(pairs, payload), "links")

    # What is left: candidates of one leader in different components.
    inside = staged(components(links, "a", "b"), "components")
    more = across_components(pairs, inside, payload)
    classes = components(links.union(more), "a", "b")

    by_digest = nodes.select("digest", "node").join(classes, "node", "left").select("digest", F.coalesce("component", "node").alias("class"))
    out = sketch.select("id", "digest").join(by_digest, "digest", "left").select("id", F.coalesce("class", "id").alias("class"))
    return out.groupBy(F.col("id").alias("doc_id")).agg(F.min("class").alias("class_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, the one with the least id; columns as they
    came. Of rows that repeat an id the one of the greatest text stays (by
    which the class was judged), of equal ones the greatest as JSON. Rows
    without an id are kept."""
    own = free_name(docs, "_kept")
    classes = near_classes(docs, id_col, text_col).filter("doc_id = class_id").select(F.col("doc_id").alias(own))
    kept = docs.join(classes, ref(docs, id_col).cast("long") == F.col(own), "left_semi")
    # Only ids that repeat are compared by their rows.
    twice, key = free_name(docs, "_twice"), free_name(docs, "_id")
    repeated = docs.groupBy(ref(docs, id_col).alias(key)).agg(F.count("*").alias(twice)).filter(F.col(twice) > 1).select(key)
    repeated = staged(repeated.filter(F.col(key).isNotNull()), "repeated-ids")
    single = join_small(kept, repeated, ref(kept, id_col) == F.col(key), "left_anti")
    many = join_small(kept, repeated, ref(kept, id_col) == F.col(key), "left_semi")
    row = F.struct(*[ref(many, c) for c in docs.columns])
    best = many.groupBy(ref(many, id_col)).agg(F.max_by(row, F.struct(ref(many, text_col), F.to_json(row))).alias("_row")).select("_row.*")
    return single.union(best).union(docs.filter(ref(docs, id_col).isNull()))
