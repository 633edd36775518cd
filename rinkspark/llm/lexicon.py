"""A minimal acyclic transducer from words to token ids.

Words are added in sorted order and finished suffixes are shared at once, so
the automaton is minimal when the last word is in. Each edge carries the number
of words that branch off before it; the sum along a word's path is the word's
rank, and the ranks address a table of id sequences. The whole is a few flat
arrays in one file, which workers map into memory.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_FIELDS = ("edge_keys", "edge_targets", "edge_weights", "final", "ids", "id_begins")


def compile_words(words: Sequence[bytes], ids: Sequence[Sequence[int]]) -> dict[str, np.ndarray]:
    """Arrays of the transducer; ``ids[i]`` is the output of ``words[i]``.
    Words must be distinct and not empty."""
    order = sorted(range(len(words)), key=words.__getitem__)
    edges: list[dict[int, int]] = [{}]  # per state: byte -> state
    final = [False]
    known: dict[tuple, int] = {}  # signature of a finished state -> state
    path = [0]  # states of the word added last
    last = b""

    def finish(depth: int) -> None:
        # Replace the states below depth by equal ones that exist already.
        while len(path) > depth + 1:
            state = path.pop()
            same = known.setdefault((final[state], tuple(edges[state].items())), state)
            edges[path[-1]][last[len(path) - 1]] = same

    for i in order:
        word = words[i]
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        finish(common)
        for byte in word[common:]:
            edges.append({})
            final.append(False)
            edges[path[-1]][byte] = len(edges) - 1
            path.append(len(edges) - 1)
        final[path[-1]] = True
        last = word
    finish(0)

    # Number the reachable states, children first for the word counts.
    counts: dict[int, int] = {}
    stack = [0]
    while stack:
        state = stack[-1]
        open_children = [t for t in edges[state].values() if t not in counts]
        if open_children:
            stack.extend(open_children)
            continue
        stack.pop()
        counts[state] = final[state] + sum(counts[t] for t in edges[state].values())
    number = {s: n for n, s in enumerate([0] + [s for s in counts if s != 0])}
    keys, targets, weights = [], [], []
    for state, n in number.items():
        before = int(final[state])
        for byte, target in sorted(edges[state].items()):
            keys.append(n * 256 + byte), targets.append(number[target]), weights.append(before)
            before += counts[target]
    by_key = np.argsort(np.array(keys, np.int64), kind="stable")
    ends = np.cumsum([0] + [len(ids[i]) for i in order])
    return {
        "edge_keys": np.array(keys, np.int64)[by_key],
        "edge_targets": np.array(targets, np.int64)[by_key],
        "edge_weights": np.array(weights, np.int64)[by_key],
        "final": np.array([final[s] for s in number], np.int64),
        "ids": np.array([x for i in order for x in ids[i]], np.int64),
        "id_begins": ends.astype(np.int64),
    }


def save(arrays: dict[str, np.ndarray], path: str) -> None:
    """One file: the sizes of the arrays, then the arrays (64-bit, little
    endian)."""
    with open(path, "wb") as out:
        np.array([len(arrays[f]) for f in _FIELDS], "<i8").tofile(out)
        for f in _FIELDS:
            arrays[f].astype("<i8").tofile(out)


class Lexicon:
    """A transducer file, mapped into memory."""

    def __init__(self, path: str):
        data = np.memmap(path, "<i8", "r")
        at = len(_FIELDS)
        for f, n in zip(_FIELDS, data[: len(_FIELDS)].tolist(), strict=True):
            setattr(self, f, data[at : at + n])
            at += n

    def __len__(self) -> int:
        return len(self.id_begins) - 1

    def ranks(self, words: Sequence[bytes]) -> np.ndarray:
        """Rank of each word, -1 for those not in the lexicon. All words take
        a step at a time."""
        n = len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        state, rank = np.zeros(n, np.int64), np.zeros(n, np.int64)
        alive = np.flatnonzero(sizes > 0) if len(self.edge_keys) else np.zeros(0, np.int64)
        out = np.full(n, -1, np.int64)
        step = 0
        while len(alive):
            key = state[alive] * 256 + data[ends[alive] - sizes[alive] + step]
            edge = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            fits = self.edge_keys[edge] == key
            alive, edge = alive[fits], edge[fits]
            state[alive] = self.edge_targets[edge]
            rank[alive] += self.edge_weights[edge]
            step += 1
            ended = sizes[alive] == step
            done = alive[ended]
            out[done] = np.where(self.final[state[done]] == 1, rank[done], -1)
            alive = alive[~ended]
        return out

    def ids_of(self, rank: int) -> np.ndarray:
        return self.ids[self.id_begins[rank] : self.id_begins[rank + 1]]
