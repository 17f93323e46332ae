"""User scripts as cleaning rules: a small expression language checked before it runs, and rules kept as configuration."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.cleaning import Registry

_METHODS = {"strip", "lstrip", "rstrip", "lower", "upper", "title", "replace", "split", "join", "startswith", "endswith", "splitlines", "casefold", "removeprefix", "removesuffix"}
_NODES = (ast.Expression, ast.Call, ast.Attribute, ast.Name, ast.Load, ast.Constant, ast.BinOp, ast.Add, ast.Subscript, ast.Slice, ast.UnaryOp, ast.USub, ast.IfExp, ast.Compare, ast.In, ast.NotIn, ast.Eq, ast.NotEq, ast.BoolOp, ast.And, ast.Or, ast.Not, ast.keyword)
_FUNCTIONS = {"len": len, "sub": lambda p, r, t: re.sub(p, r, t), "str": str}


@dataclass(frozen=True)
class Script:
    """An expression of `text` and `source`. It fails open: the text stays as it was and the error is told."""

    code: str
    max_in: int = 1_000_000
    max_out: int = 1_000_000

    def __post_init__(self):
        tree = ast.parse(self.code, mode="eval")
        for node in ast.walk(tree):
            if not isinstance(node, _NODES):
                raise ValueError(f"{type(node).__name__} is not allowed")
            if isinstance(node, ast.Attribute) and node.attr not in _METHODS:
                raise ValueError(f"method {node.attr} is not allowed")
            if isinstance(node, ast.Name) and node.id not in {"text", "source", *_FUNCTIONS}:
                raise ValueError(f"name {node.id} is not allowed")

    def run(self, text: str, source: str = "") -> tuple[str, str | None]:
        if len(text) > self.max_in:
            return text, "text too long"
        try:
            out = eval(compile(ast.parse(self.code, mode="eval"), "<rule>", "eval"), {"__builtins__": {}}, {"text": text, "source": source, **_FUNCTIONS})
        except Exception as e:  # noqa: BLE001
            return text, f"{type(e).__name__}: {e}"
        if not isinstance(out, str):
            return text, "result is no text"
        return (text, "result too long") if len(out) > self.max_out else (out, None)

    def column(self, text: Column, source: Column) -> Column:
        """struct<text, error>"""
        script = self

        @F.pandas_udf("text string, error string")
        def each(t: pd.Series, s: pd.Series) -> pd.DataFrame:
            rows = [(None, None) if x is None else script.run(x, y or "") for x, y in zip(t, s)]
            return pd.DataFrame(rows, columns=["text", "error"])

        return each(text, source)


@dataclass(frozen=True)
class StoredRule:
    rule_id: str
    code: str
    pattern: str = ""
    kind: str = "none"
    enabled: bool = True


class RuleManager:
    """Rules as rows: create, change, delete, test, and the registry of all enabled ones that compile."""

    def __init__(self):
        self._rules: dict[str, StoredRule] = {}

    def put(self, rule: StoredRule) -> None:
        self._rules[rule.rule_id] = rule

    def delete(self, rule_id: str) -> bool:
        return self._rules.pop(rule_id, None) is not None

    def enable(self, rule_id: str, on: bool = True) -> None:
        r = self._rules[rule_id]
        self._rules[rule_id] = StoredRule(r.rule_id, r.code, r.pattern, r.kind, on)

    @staticmethod
    def status(rule: StoredRule) -> str | None:
        try:
            Script(rule.code)
            if rule.kind == "regex":
                re.compile(rule.pattern)
        except (ValueError, SyntaxError, re.error) as e:
            return f"{type(e).__name__}: {e}"
        return None

    def test(self, rule_id: str, text: str, source: str = "") -> tuple[str, str | None]:
        return Script(self._rules[rule_id].code).run(text, source)

    def registry(self) -> Registry:
        out = Registry()
        for r in self._rules.values():
            if r.enabled and self.status(r) is None:
                script = Script(r.code)
                out.add(lambda c, s=script: s.column(c, F.lit(""))["text"], r.pattern, r.kind)
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(r.rule_id, r.code, r.pattern, r.kind, r.enabled, self.status(r)) for r in self._rules.values()]
        return spark.createDataFrame(rows, "rule_id string, code string, pattern string, kind string, enabled boolean, error string")
