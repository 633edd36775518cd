"""Output rounding shared by the registered queries and their oracles.

Results are compared across engines after rounding doubles to 4 places.
An average of 2-decimal values can sit exactly on a rounding tie (e.g.
53.41125 = sum / 32), where engines disagree on the binary neighbour of the
tie. Both sides therefore round ``x + 1e-9``: ties go up consistently, and
an average over fewer than 10,000 rows that is not a tie lies at least
5e-9 from a rounding boundary, so its rounded value is unchanged.
``+ 0.0`` turns a rounded -0.0 into 0.0.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TIE_BIAS = 1e-9


def rnd4(c: Column) -> Column:
    return F.round(c + F.lit(TIE_BIAS), 4) + F.lit(0.0)


def r4(name: str) -> Column:
    return rnd4(F.col(name)).alias(name)


def sql_round4(text: str) -> str:
    """Apply the same bias to every ``round(x, 4)`` of an oracle text (found
    by matching parentheses, so a type like DECIMAL(18, 4) is left alone; a
    rounding that has the bias already is left alone too)."""
    out, at = [], 0
    for m in re.finditer(r"\bround\(", text, re.IGNORECASE):
        depth, i = 1, m.end()
        while depth and i < len(text):
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        bias = f" + {TIE_BIAS}"
        if text[m.end() : i].endswith(", 4)") and not text[: i - 4].endswith(bias):
            out.append(text[at : i - 4] + bias if i - 4 >= at else "")
            at = i - 4
    return "".join(out) + text[at:]
