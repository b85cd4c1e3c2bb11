"""Configured amount and condition expressions.

``:name`` stands for a column. The text is checked token by token against a
whitelist and handed to Spark SQL, which does the parsing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS = {"abs": "abs", "min": "least", "max": "greatest", "round": "round"}
WORDS = {"and", "or", "not", "is", "null", "in"}

_TOKEN = re.compile(
    r"\s*(?:(?P<column>:[A-Za-z_]\w*)|(?P<number>\d+(?:\.\d+)?)|(?P<text>'[A-Za-z0-9_ \-]*')"
    r"|(?P<word>[A-Za-z_]\w*)|(?P<sign><=|>=|<>|!=|[-+*/(),<>=]))"
)


def compile_expression(text: str, columns: Iterable[str]) -> Column:
    """Column for ``text``; ValueError for anything outside the whitelist."""
    known, out, pos, body = set(columns), [], 0, text.strip()
    if not body:
        raise ValueError("empty expression")
    while pos < len(body):
        m = _TOKEN.match(body, pos)
        if not m:
            raise ValueError(f"illegal character at {pos} in expression: {text}")
        pos = m.end()
        token = m.group().strip()
        if m.group("column"):
            if token[1:] not in known:
                raise KeyError(f"unknown column {token} in expression: {text}")
            out.append(f"`{token[1:]}`")
        elif m.group("word"):
            name = token.lower()
            if name in FUNCTIONS and body[pos:].lstrip().startswith("("):
                out.append(FUNCTIONS[name])
            elif name in WORDS:
                out.append(name)
            else:
                raise ValueError(f"unknown word {token} in expression: {text}")
        else:
            out.append(token)
    return F.expr(" ".join(out))
