"""Components against a plain search."""

import random

from lintlake.llm.graph import components


def brute(links):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    root = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = start
                todo += near[x]
    return root


def got(spark, links):
    df = spark.createDataFrame(links, "a bigint, b bigint")
    return {r.node: r.root for r in components(df).collect()}


def test_random_links_chain_and_star(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    chain = [(1000 + i, 1001 + i) for i in range(70)]
    star = [(5000, 5000 - i) for i in range(1, 60)]
    every = links + chain + star
    assert got(spark, every + [(None, 1), (2, None), (7, 7)]) == brute(
        [(a, b) for a, b in every if a != b]
    )


def test_no_links(spark):
    assert got(spark, []) == {}
