"""Cell-level visibility: expressions of terms with & and | decide what given authorisations may see."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_word = re.compile(r'\s*("(?:[^"\\]|\\.)*"|[A-Za-z0-9_\-:./]+|[&|()])')


def visible(expression: str | None, authorisations: frozenset[str]) -> bool:
    """An empty expression is visible; & and | do not mix without parentheses."""
    if not expression or not expression.strip():
        return True
    words, at, text = [], 0, expression.strip()
    while at < len(text):
        m = _word.match(text, at)
        if not m:
            raise ValueError(f"bad visibility: {expression}")
        words.append(m[1])
        at = m.end()

    def group(i: int) -> tuple[bool, int]:
        values, op = [], None
        while True:
            if i >= len(words):
                raise ValueError(f"bad visibility: {expression}")
            if words[i] == "(":
                value, i = group(i + 1)
                if i >= len(words) or words[i] != ")":
                    raise ValueError(f"bad visibility: {expression}")
                i += 1
            elif words[i] in ("&", "|", ")"):
                raise ValueError(f"bad visibility: {expression}")
            else:
                value, i = words[i].strip('"').replace('\\"', '"') in authorisations, i + 1
            values.append(value)
            if i >= len(words) or words[i] == ")":
                return (all(values) if op == "&" else any(values)), i
            if words[i] not in "&|" or op not in (None, words[i]):
                raise ValueError(f"mixed & and | in visibility: {expression}")
            op, i = words[i], i + 1

    value, end = group(0)
    if end != len(words):
        raise ValueError(f"bad visibility: {expression}")
    return value


def authorised(df: DataFrame, column: str, authorisations: list[str]) -> DataFrame:
    """The rows that the authorisations may see. Expressions are judged in Arrow batches, each text once a batch."""
    granted = frozenset(authorisations)

    @F.pandas_udf("boolean")
    def see(texts: pd.Series) -> pd.Series:
        texts = texts.fillna("")
        return texts.map({x: visible(x, granted) for x in texts.unique()})

    return df.filter(see(F.col(column)))


def mentions(df: DataFrame, column: str, authorisation: str) -> DataFrame:
    """The rows whose visibility names an authorisation."""
    return df.filter(F.array_contains(F.split(F.col(column), r'[&|()"\s]+'), authorisation))
