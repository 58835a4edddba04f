"""Exact spans of Python statements from the standard syntax tree.

Only files that hold one of the statements travel to Python, in Arrow batches.  Files the
tree builder refuses keep the spans the token shapes give.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake import schemas
from lintlake.operators.scan import facts_of

_SHAPES = {"except_bare": "bare_except", "stmt_keyword": "statement"}


def _spans(src: str) -> list[tuple] | None:
    """(shape, start line, start byte, end line, end byte) of the statements."""
    try:
        tree = ast.parse(src)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    found = []
    for node in ast.walk(tree):
        if isinstance(node, ast.ExceptHandler) and node.type is None:
            shape = "except_bare"
        elif isinstance(node, (ast.Global, ast.Assert)):
            shape = "stmt_keyword"
        else:
            continue
        found.append(
            (shape, node.lineno, node.col_offset, node.end_lineno, node.end_col_offset)
        )
    return sorted(found, key=lambda s: s[1:3])


def _text(lines: list[bytes], span: tuple) -> str:
    _, l0, c0, l1, c1 = span
    rows = list(lines[l0 - 1 : l1])
    rows[-1] = rows[-1][:c1]
    rows[0] = rows[0][c0:]
    return b"\n".join(rows).decode()


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for path, src in zip(frame["path"], frame["src"], strict=True):
            spans = _spans(src)
            if spans is None:
                rows.append((path, None, None, None))
                continue
            lines = src.encode().split(b"\n")
            for n, s in enumerate(spans):
                cap = {
                    "name": _SHAPES[s[0]],
                    "text": _text(lines, s),
                    "start_line": s[1],
                    "start_column": s[2] + 1,
                    "end_line": s[3],
                    "end_column": s[4] + 1,
                }
                rows.append((path, s[0], n, [cap]))
        yield pd.DataFrame(rows, columns=["path", "shape", "fact_no", "caps"])


def python_ast_facts(corpus: DataFrame) -> DataFrame:
    """Facts of the shapes except_bare and stmt_keyword for the Python files."""
    texts = corpus.where(
        (F.lower("language") == "python") & F.col("src").rlike(r"\b(?:except|global|assert)\b")
    )
    schema = f"path string, shape string, fact_no int, caps array<{schemas.CAPTURE}>"
    read = texts.select("path", "src").mapInPandas(_batches, schema)
    exact = read.where(F.col("shape").isNotNull()).select(
        "path", F.lit("python").alias("language"), "shape", "fact_no", "caps"
    )
    refused = read.where(F.col("shape").isNull()).select("path")
    wanted = {("python", s): [()] for s in _SHAPES}
    plain = facts_of(texts.join(refused, "path", "left_semi"), wanted)
    return exact.unionByName(plain.select(*exact.columns))
