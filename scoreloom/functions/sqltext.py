"""Values as SQL text.

Scores are written as SQL expressions: one text serves as a column and as the
body of a SQL function, and building it takes one call instead of dozens.
"""

from __future__ import annotations

import math
from collections.abc import Iterable


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(value: float) -> str:
    value = float(value)
    return f"CAST({value!r} AS DOUBLE)" if math.isfinite(value) else f"CAST('{value!r}' AS DOUBLE)"


def column(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def contains_any(body: str, words: Iterable[str]) -> str:
    hits = [f"contains({body}, {text(word)})" for word in words]
    return "(" + " OR ".join(hits) + ")" if hits else "FALSE"
