"""Text cleaning as column expressions; a pipeline is a composition that Catalyst fuses into one projection."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[Column], Column]

#: White space as Python's str.strip sees it, less the line feed, for a character class.
SPACE = r" \t\x{0b}\x{0c}\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends, as Python's strip."""
    return F.regexp_replace(c, rf"\A[{SPACE}\n]+|[{SPACE}\n]+\z", "")


def strip_bom(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\x{FEFF}+", "")


def line_ends(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def strip_trailing(c: Column) -> Column:
    """White space at line ends, then at both ends of the text."""
    lines = F.regexp_replace(c, rf"[{SPACE}]+(\n|\z)", "$1")
    return F.regexp_replace(lines, rf"\A[{SPACE}\n]+|[{SPACE}\n]+\z", "")


def collapse_blank(max_blanks: int = 1) -> Rule:
    if max_blanks < 0:
        raise ValueError("max_blanks must be >= 0")
    return lambda c: F.regexp_replace(c, "\n{%d,}" % (max_blanks + 2), "\n" * (max_blanks + 1))


def strip_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!--.*?-->", "")


def replace(pattern: str, by: str, count: int = 0, flags: str = "") -> Rule:
    """Regular replacement. Unlimited ones stay in the JVM (Python's \\1 becomes $1); a limit needs a pandas function."""
    if count < 0:
        raise ValueError("count must be >= 0")
    if count == 0:
        java = re.sub(r"\\(\d)", r"$\1", by.replace("$", r"\$"))
        return lambda c: F.regexp_replace(c, (f"(?{flags})" if flags else "") + pattern, java)
    compiled = re.compile((f"(?{flags})" if flags else "") + pattern)

    @F.pandas_udf("string")
    def limited(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else compiled.sub(by, t, count=count))

    return lambda c: limited(c)


def call(f: Callable[[str], str]) -> Rule:
    """Any Python function of a text, in Arrow batches."""

    @F.pandas_udf("string")
    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else f(t))

    return lambda c: each(c)


DEFAULT: list[Rule] = [strip_bom, line_ends, strip_controls, strip_trailing, collapse_blank(1)]


def clean(c: Column, rules: Sequence[Rule] = ()) -> Column:
    """The default rules in order, then the given ones."""
    for rule in [*DEFAULT, *rules]:
        c = rule(c)
    return c


def glob_to_regex(glob: str) -> str:
    out = ""
    k = 0
    while k < len(glob):
        ch = glob[k]
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif ch == "[" and (end := glob.find("]", k + 2)) > 0:
            body = glob[k + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            k = end
        else:
            out += re.escape(ch)
        k += 1
    return rf"(?s)\A{out}\z"


@dataclass(frozen=True)
class Routed:
    """A rule for some sources: everywhere (kind none), by glob on the whole path or its base name, or by regex search."""

    rule: Rule
    pattern: str = ""
    kind: str = "none"

    def __post_init__(self):
        if self.kind not in ("none", "glob", "regex"):
            raise ValueError(f"unknown kind {self.kind}")

    def applies(self, source: Column) -> Column:
        s = F.coalesce(source, F.lit(""))
        if self.kind == "none" or not self.pattern:
            return F.lit(True)
        if self.kind == "regex":
            return s.rlike(self.pattern)
        g = glob_to_regex(self.pattern)
        return s.rlike(g) | F.regexp_extract(s, r"([^/\\]*)\z", 1).rlike(g)


@dataclass
class Registry:
    """Rules in the order of their registration, each applied where its source matches."""

    rules: list[Routed] = field(default_factory=list)

    def add(self, rule: Rule, pattern: str = "", kind: str | None = None) -> "Registry":
        self.rules.append(Routed(rule, pattern, kind or ("glob" if pattern else "none")))
        return self

    def clean(self, text: Column, source: Column, defaults: bool = True) -> Column:
        c = clean(text) if defaults else text
        for r in self.rules:
            c = F.when(r.applies(source), r.rule(c)).otherwise(c)
        return c


def clean_frame(df: DataFrame, text_col: str, source_col: str | None = None, registry: Registry | None = None, into: str = "cleaned") -> DataFrame:
    source = F.col(source_col) if source_col else F.lit("")
    return df.withColumn(into, (registry or Registry()).clean(F.col(text_col), source))
