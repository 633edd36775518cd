"""Name normalisation and the cross-source player key.

All JVM-side: ``translate`` with character tables generated once from the
Unicode database, ``regexp_replace`` and array functions. No Python UDF.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from rinkspark.functions.scoring import ColumnLike, _col

# Precomposed Hangul syllables, and the letters they are made of: leads x
# vowels x (no tail or one of the tails), in code point order.
_SYLLABLES = range(0xAC00, 0xD7A4)
_LEADS, _VOWELS, _TAILS = ("".join(map(chr, r)) for r in (range(0x1100, 0x1113), range(0x1161, 0x1176), range(0x11A8, 0x11C3)))
# Where the places of multi-letter forms are counted from (private use).
_PLACES = 0xF0000


def _strip(ch: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))


class _Tables(NamedTuple):
    src: str  # characters that become one other character,
    dst: str  # that character
    gone: str  # characters that vanish
    multi: str  # characters that become several (syllables aside)
    forms: tuple[str, ...]  # what they become
    spelled: str  # pattern of multi and the syllables


@lru_cache(maxsize=1)
def _accent_tables() -> _Tables:
    """Built by rule from the Unicode database of this Python. Marks that order
    among themselves are all dropped, so every character stands alone."""
    src, dst, gone, multi, forms = [], [], [], [], []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or cp in _SYLLABLES:
            continue
        ch = chr(cp)
        out = _strip(ch)
        if out == ch:
            continue
        if len(out) == 1:
            src.append(ch)
            dst.append(out)
        elif not out:
            gone.append(ch)
        else:
            multi.append(ch)
            forms.append(out)
    ranges = [[_SYLLABLES[0], _SYLLABLES[-1]]]
    for cp in map(ord, multi):
        if cp == ranges[-1][1] + 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    spelled = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"
    return _Tables("".join(src), "".join(dst), "".join(gone), "".join(multi), tuple(forms), spelled)


def _spelled(ch: Column) -> Column:
    """A character that stands for several, in full: syllables by arithmetic,
    other forms from a table, by their place in it."""
    t = _accent_tables()
    one = F.lit(1)
    n = F.ascii(ch) - F.lit(_SYLLABLES[0])
    lead, vowel, tail = F.floor(n / 588).cast("int"), F.floor(n % 588 / 28).cast("int"), n % 28
    syllable = F.concat(
        F.substr(F.lit(_LEADS), lead + one, one),
        F.substr(F.lit(_VOWELS), vowel + one, one),
        F.when(tail == 0, F.lit("")).otherwise(F.substr(F.lit(_TAILS), tail, one)),
    )
    place = F.translate(ch, t.multi, "".join(chr(_PLACES + i) for i in range(len(t.multi))))
    form = F.get(F.split(F.lit("\n".join(t.forms)), "\n"), F.ascii(place) - F.lit(_PLACES))
    return F.when(ch < F.lit("\x80"), ch).when(n.between(0, len(_SYLLABLES) - 1), syllable).when(place != ch, form).otherwise(ch)


def strip_accents(name: ColumnLike) -> Column:
    """compatibility-decompose, drop combining marks; null -> ''. Texts
    without multi-letter forms (nearly all) need the first table only."""
    t = _accent_tables()
    # translate deletes characters of `from` that have no partner in `to`.
    c = F.translate(F.coalesce(_col(name), F.lit("")), t.src + t.gone, t.dst)
    return F.when(c.rlike(t.spelled), F.array_join(F.transform(F.split(c, ""), _spelled), "")).otherwise(c)


def clean_name(name: ColumnLike) -> Column:
    """lower, ``-`` -> space, a space after the inner dot of initials,
    drop dots, squeeze blanks, trim; null -> ''."""
    c = F.lower(F.coalesce(_col(name), F.lit("")))
    c = F.replace(c, F.lit("-"), F.lit(" "))
    c = F.regexp_replace(c, r"([a-z])\.([a-z])", "$1. $2")
    c = F.replace(c, F.lit("."), F.lit(""))
    c = F.regexp_replace(c, r"(?U)\s+", " ")
    return F.regexp_replace(c, r"^ | $", "")


def name_form(name: ColumnLike) -> Column:
    """first initial + last word (``jmiller``); one word stays whole."""
    cleaned = clean_name(name)
    parts = F.split(cleaned, " ")
    # Both words in one pass; a cleaned name holds no line end.
    both = strip_accents(F.concat(F.element_at(parts, 1), F.lit("\n"), F.element_at(parts, -1)))
    last = F.substring_index(both, "\n", -1)
    two_plus = F.regexp_replace(F.concat(F.substring(both, 1, 1), last), r"(?U)[\s\-]", "")
    return F.when(cleaned == "", F.lit("")).when(F.size(parts) < 2, last).otherwise(two_plus)


def player_key(name: ColumnLike, position: ColumnLike) -> Column:
    """``<name form>-<position initial>``; '' when either is empty."""
    n, p = _col(name), _col(position)
    missing = F.coalesce(n, F.lit("")).eqNullSafe("") | F.coalesce(p, F.lit("")).eqNullSafe("")
    return F.when(missing, F.lit("")).otherwise(
        F.concat(name_form(n), F.lit("-"), F.upper(F.substring(p, 1, 1)))
    )
