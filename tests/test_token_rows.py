"""Tokens as rows: long texts in pieces give the rows of whole texts."""

import random

from lintlake import schemas
from lintlake.operators import tokens as tk
from lintlake.plans import views as V


def test_pieces_give_the_same_rows(spark, sf):
    random.seed(11)
    bits = ["x", "return ", "/a b/g", " / ", "'s\\'t'", '"', "'", "`t ${a}`", "`", "// c\n", "/* c\n */", "#", "\n", "  ",
            "rb", '"""d\n"""', "é", "1", ".5", "?.", "=>", "a.b", " ", "#!x\n"]
    odd = [
        (f"{lang}{k}", lang, "".join(random.choices(bits, k=400)), "")
        for lang in ("javascript", "typescript", "python")
        for k in range(8)
    ] + [("empty", "python", "", ""), ("null", "python", None, ""), ("html", "html", "<p>", ""), ("upper", "JavaScript", "a\nb", "")]
    corpus = spark.createDataFrame(odd, schemas.CORPUS).unionByName(
        V.all_code(spark, sf).select("path", "language", "src", "content_sha")
    )
    whole = sorted(map(tuple, tk.token_rows(corpus).collect()))
    for size in (1, 7):
        assert sorted(map(tuple, tk.token_rows(corpus, 0, size).collect())) == whole
    texts = {p: t or "" for p, _, t, _ in odd}
    seen = {}
    for path, _, number, at, line, col, text in whole:
        if path in texts:
            before = texts[path].encode()[:at]
            assert texts[path].encode()[at:].startswith(text.encode())
            assert line == before.count(b"\n") + 1 and col == at - (before.rfind(b"\n") + 1) + 1
            assert number == seen.get(path, 0)
            seen[path] = number + 1
    assert {"empty", "null", "html"}.isdisjoint(seen) and seen["upper"] == 2


def test_a_long_file_is_many_tasks(spark):
    text = "let a = [1, 2]; // x\n" * 20_000
    corpus = spark.createDataFrame([("a.js", "javascript", text, "")], schemas.CORPUS)
    rows = tk.token_rows(corpus, long_bytes=100_000, piece_tokens=512)
    assert rows.count() == 9 * 20_000
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # as small as this one is, its pieces would be read by one task
    try:
        tasks = rows.selectExpr("spark_partition_id() as p").groupBy("p").count().collect()
    finally:
        spark.conf.unset(coalesce)
    assert len(tasks) > 1
    last = rows.orderBy("token_no", ascending=False).first()
    assert (last.line, last.col, last.at) == (20_000, 15, 21 * 20_000 - 7)


def test_token_rows_are_not_sorted(spark):
    corpus = spark.createDataFrame([("a.js", "javascript", "let a = 1;", "")], schemas.CORPUS)
    found = tk.token_rows(corpus, long_bytes=4, piece_tokens=2)._jdf.queryExecution().optimizedPlan().toString()
    # the only windows left are those over the pieces of a file, none over tokens
    assert "Window" in found and not any("text#" in x for x in found.splitlines() if "Window" in x)
    assert found.count("Window") <= 4 and found.count("Sort ") == 0
