"""Cutting texts into the pre-tokens of a tokenizer file, and memoised
encoding of pre-tokens.

A tokenizer encodes each pre-token on its own, so a text's ids are those of
its pre-tokens end to end. Pre-tokens are found here by a compiled pattern for
texts made only of characters whose classes and normal forms are the same in
every Unicode version (Latin with its extensions, common punctuation); any
other text, and any text that holds an added token's string, is encoded whole
by the library.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Sequence

import numpy as np

from rinkspark.llm.text_arrays import ragged

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters of texts that are cut here: white space, ASCII, Latin-1 and
#: Latin Extended-A without those that change length or form when lower-cased.
SAFE = [chr(c) for c in [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x180)] if c not in (0xAD, 0x130, 0x149)]
_UNSAFE = re.compile("[^" + re.escape("".join(SAFE)) + "]")


def _class(major: str) -> str:
    return re.escape("".join(c for c in SAFE if unicodedata.category(c)[0] == major))


_L, _N = _class("L"), _class("N")

#: word_bpe_49k.json, behind its normaliser (white space joined, lower case).
WORD_PATTERN = re.compile(rf"[{_L}]+|'(?:[stmd]|re|ve|ll)|[{_N}]|[^\s{_L}{_N}]+")
#: byte_bpe_50k.json.
BYTE_PATTERN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")

#: Memoised pre-tokens of a worker; beyond it the less used half is dropped.
CACHE_WORDS = 250_000


def load(tokenizer_json: str):
    """The tokenizer of a file's content, without truncation and padding."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer_json)
    tok.no_truncation()
    tok.no_padding()
    return tok


def cutter(tok, pattern: re.Pattern, lower: bool) -> Callable[[str], list[str] | None]:
    """Text -> its pre-tokens, or None if the library must take it whole."""
    added = [t.content for t in tok.get_added_tokens_decoder().values()]

    def cut(text: str) -> list[str] | None:
        if _UNSAFE.search(text) or any(a in text for a in added):
            return None
        return pattern.findall(text.lower() if lower else text)

    return cut


class _Codes(dict):
    """Numbers words in order of first sight and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class WordCache:
    """Numbers the pre-tokens of texts; what is known of each number is kept
    by a subclass in arrays, for at most ``limit`` pre-tokens."""

    def __init__(self, cut: Callable[[str], list[str] | None], limit: int = CACHE_WORDS):
        self.cut, self.limit = cut, limit
        self.codes, self.uses = _Codes(), np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        """Append what is to be known of new words, in order."""
        raise NotImplementedError

    def keep(self, rows: np.ndarray) -> None:
        """Go on with these rows only, renumbered in order."""
        raise NotImplementedError

    def _shrink(self) -> None:
        rows = np.sort(np.argsort(-self.uses, kind="stable")[: self.limit // 2])
        words = list(self.codes)
        self.codes = _Codes()
        for r in rows.tolist():
            self.codes[words[r]] = len(self.codes)
        self.uses = self.uses[rows] // 2
        self.keep(rows)

    def numbered(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Numbers of all pre-tokens end to end, the first of each text (with
        the end last), and the texts that the library must take whole."""
        if len(self.codes) > self.limit:
            self._shrink()
        look, coded, whole = self.codes.__getitem__, [], []
        for i, text in enumerate(texts):
            words = self.cut(text)
            if words is None:
                whole.append(i)
                words = []
            coded.append(np.fromiter(map(look, words), np.int64, len(words)))
        fresh, self.codes.fresh = self.codes.fresh, []
        if fresh:
            self.learn(fresh)
        codes = np.concatenate(coded) if coded else np.zeros(0, np.int64)
        used = np.bincount(codes, minlength=len(self.codes))
        used[: len(self.uses)] += self.uses
        self.uses = used
        return codes, np.cumsum([0] + [len(c) for c in coded]), whole


class Memo(WordCache):
    """Ids of texts. ``encode_words`` maps distinct pre-tokens to their ids
    end to end and the number of ids of each."""

    def __init__(self, tok, cut: Callable[[str], list[str] | None], encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = CACHE_WORDS):
        super().__init__(cut, limit)
        self.tok, self.encode_words = tok, encode_words
        self.flat, self.begins = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, words: list[str]) -> None:
        ids, sizes = self.encode_words(words)
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(sizes)])

    def keep(self, rows: np.ndarray) -> None:
        sizes = self.begins[rows + 1] - self.begins[rows]
        self.flat = ragged(self.flat, self.begins, rows)
        self.begins = np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and each text's first (with the end last)."""
        codes, first, whole = self.numbered(texts)
        ids = ragged(self.flat, self.begins, codes)
        ends = np.concatenate([[0], np.cumsum(self.begins[codes + 1] - self.begins[codes])])
        begins = ends[first]
        for i in whole:
            own = np.array(self.tok.encode(texts[i], add_special_tokens=False).ids, np.uint32)
            ids = np.concatenate([ids[: begins[i]], own, ids[begins[i] :]])
            begins[i + 1 :] += len(own)
        return ids, begins


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves,
    the others follow from code point 256 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)}


_LETTERS = _byte_letters()
_AS_IS = re.compile(r"[!-~]+")


def library_encoder(tok) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Ids of pre-tokens, end to end, and the number of ids of each: the
    merges of the library's own model, on the bytes' letters."""
    merge = tok.model.tokenize

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [[t.id for t in merge(w if _AS_IS.fullmatch(w) else w.encode().decode("latin-1").translate(_LETTERS))] for w in words]
        return np.fromiter((i for x in found for i in x), np.uint32), np.array([len(x) for x in found], np.int64)

    return encode
