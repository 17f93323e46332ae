"""JSON out of noisy text: fences, prose around it, trailing commas, cut-off arrays."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"^\s*```[A-Za-z]*\s*\n(.*?)\n?\s*```\s*$", re.S)


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("?)|[\[\]{}]', re.S)


def _closed(s: str) -> str:
    """Open strings and brackets closed, commas before a closing bracket dropped."""
    stack, quoted = [], False
    for m in _TOKEN.finditer(s):
        if m[0][0] == '"':
            quoted = not m[1]  # only the last string can be open
        elif m[0] in "[{":
            stack.append("]" if m[0] == "[" else "}")
        elif stack:
            stack.pop()
    if quoted and (len(s) - len(s.rstrip("\\"))) % 2:
        s = s[:-1]  # half an escape
    out = s + ('"' if quoted else "")
    out = re.sub(r"[,:]\s*$", "", out) + "".join(reversed(stack))
    return re.sub(r",\s*([\]}])", r"\1", out)


def salvage(text: str | None):
    """The value, or None: as it is, without fence, between the outermost brackets, closed, or an array up to its last whole object."""
    if not text or not text.strip():
        return None
    s = m[1] if (m := _FENCE.match(text)) else text
    tries = [s]
    starts = [k for k in (s.find("{"), s.find("[")) if k >= 0]
    if starts:
        low = min(starts)
        high = max(s.rfind("}"), s.rfind("]"))
        if high > low:
            tries += [s[low : high + 1], _closed(s[low : high + 1])]
        tries.append(_closed(s[low:]))
        if s[low] == "[" and (last := s.rfind("}")) > low:
            tries.append(_closed(s[low : last + 1]))
    for t in tries:
        try:
            return json.loads(t)
        except ValueError:
            continue
    return None


def extract_json(c: Column) -> Column:
    """Sound JSON is parsed in the JVM; only what fails goes through Python."""

    @F.pandas_udf("string")
    def salvaged(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if (v := salvage(t)) is None else json.dumps(v, ensure_ascii=False, sort_keys=True))

    return F.when(F.try_parse_json(c).isNotNull(), c).otherwise(salvaged(c))
