"""Bracket tables of long files against walks token by token."""

import random

import pytest
from pyspark.sql import functions as F

from lintlake.operators import scan as sc
from lintlake.operators import shapes as sh
from lintlake.plans.catalog import bundled_rules

STOP = sh.begins("j", ";")


def frame(spark, files):
    padded = [([""] * sh.HEAD + x + [""] * sh.TAIL,) for x in files]
    return spark.createDataFrame(padded, "tok array<string>")


def plain(tok):
    """By token: innermost opener, nearest stop or opener at its depth, closer."""
    none, stack = sh.HEAD - 1, [[sh.HEAD - 1, sh.HEAD - 1]]
    up, last, mate = [], [], {}
    for j, t in enumerate(tok):
        up.append(stack[-1][0])
        last.append(stack[-1][1])
        if t[:1] in "([{" and t:
            stack.append([j, j])
            mate[j] = len(tok) - sh.TAIL - 1
        elif t[:1] in ")]}" and t:
            if len(stack) > 1:
                mate[stack.pop()[0]] = j
            else:
                stack[-1][1] = none
        elif t.startswith(";"):
            stack[-1][1] = j
    return up, last, mate


@pytest.fixture(scope="module")
def files():
    random.seed(7)
    words = ["(", ")", "[", "]", "{", "}", ";", "x ", "y"]
    out = [[], ["x"], [")"], ["("], [")", ";", "(", "x", ")"]]
    out += [random.choices(words, [3, 3, 1, 1, 2, 2, 2, 4, 4], k=n) for n in (30, 300, 5000)]
    out += [["("] * 150 + ["x"] + [")"] * 150, random.choices("()", k=4200)]
    return out


def test_tables_by_brute_force(spark, files):
    sh.back("i", STOP)  # gives the stop a table
    level = sh.table(sh._STOPS[STOP])
    rows = frame(spark, files).select(
        "tok", F.expr(sh.table("level0")).alias("up"), F.expr(level).alias("last"), F.expr(sh.table("mates")).alias("mate")
    )
    for r in rows.collect():
        up, last, mate = plain(r.tok)
        assert [x.o for x in r.up][: len(up)] == up
        assert [x.last for x in r["last"]][: len(last)] == last
        assert {j: r.mate[j] for j in mate} == mate


def test_walks_and_tables_agree(spark, files):
    """The same matches with a table for every file and without any."""
    texts = [
        "\n".join(f"f{k}((a: any) => {{ g[{k}] = (b as any); }}, [c!.d]);" for k in range(60)),
        "let x: any\n" * 400,
        "function f(a: any, b = { c: any }) { if (x) { y as any } }\n" * 80 + "} ) ]",
        "(" * 40 + "z as any" + "; q(a, `s`)" * 300,
    ]
    corpus = spark.createDataFrame(
        [(f"{k}.ts", "typescript", t) for k, t in enumerate(texts)], "path string, language string, src string"
    )
    walked, found = sh.WALKED, []
    try:
        for sh.WALKED in (-1, 1 << 40):
            rows = sc.scan_all(corpus, bundled_rules()).collect()
            found.append(sorted(map(tuple, rows)))
    finally:
        sh.WALKED = walked
    assert found[0] == found[1] and len(found[0]) > 500


def test_a_long_file(spark):
    n = 3000
    text = "\n".join(f"let x{k}: any = f(y{k} as any)" for k in range(n))
    corpus = spark.createDataFrame([("a.ts", "typescript", text)], "path string, language string, src string")
    rows = sc.scan_all(corpus, bundled_rules().only("ts-no-any-annotation,ts-no-as-any")).collect()
    lines = {(r.rule_id, r.start_line) for r in rows}
    assert lines == {(x, k + 1) for k in range(n) for x in ("ts-no-any-annotation", "ts-no-as-any")}
    assert len(rows) == 2 * n
