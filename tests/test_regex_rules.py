"""Regex rules found by their literals give what trying every regex gives."""

from pyspark.sql import functions as F

from lintlake import schemas
from lintlake.operators import scan as sc
from lintlake.plans import views as V

REGEXES = [
    "^fetch\\w*$", "eval|exec", "(pri)?nt", "^[ae]lert", "a+lert", "al{1}ert", "e?val", "(?i)EVAL",
    "\\bexec\\b", "fe(t)ch", "^$", "", ".", "prin[t]", "x\\.y", "e.al$", "fetc(h)*", "\\x65val", "ale[^x]t",
]


def rules(spark, regexes):
    rows = [
        (n, f"r{n}", "n", "error", lang, "m", None, "call", [("fn", "match", x)], ["fn"])
        for n, (x, lang) in enumerate((x, lang) for x in regexes for lang in ("javascript", "python"))
    ]
    types = (
        "rule_no int, id string, name string, severity string, language string, message string, "
        f"metadata string, shape string, where {schemas.WHERE}, report array<string>"
    )
    return spark.createDataFrame(rows, types)


def test_same_issues_as_trying_every_regex(spark, sf):
    corpus = V.code_corpus(spark, sf, "javascript").unionByName(V.code_corpus(spark, sf, "python"))
    issues = sc.scan_all(corpus, rules(spark, REGEXES))
    found = issues.groupBy("rule_id").agg(F.count("*").alias("n"), F.min("code_snippet").alias("low"))
    calls = sc.facts_of(corpus, {(x, "call"): [()] for x in ("javascript", "python")})
    texts = calls.select("language", F.col("caps")[0]["text"].alias("text"))
    every = texts.join(rules(spark, REGEXES), "language").where(F.expr("rlike(text, where[0].value)"))
    want = every.groupBy(F.col("id").alias("rule_id")).agg(F.count("*").alias("n"), F.min("text").alias("low"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert found.count() > 20


def test_joined_rows_grow_with_hits(spark, sf):
    """10,000 regexes that no call has the literal of are not tried."""
    corpus = V.code_corpus(spark, sf, "javascript")
    some = [f"^eval_+{n}(x)?$" for n in range(5000)] + ["^eval(x)?$"]
    keyed = sc._with_keys(rules(spark, some))
    searches = sc._searches(keyed)
    assert searches.where("capture = ''").count() == 0
    found = sc.facts_of(corpus, {("javascript", "call"): [()]})
    by = found.select("language", "shape", "fact_no", F.explode(sc._met_by(searches)).alias("by"))
    joined = by.select("language", "shape", "by.*").join(searches, sc._ON).count()
    real = found.where("caps[0].text = 'eval'").count()
    assert 0 < real <= joined <= 2 * real


def test_required_texts(spark):
    given = {"a+bcd": "bcd", "foo\\.bar": "foo.bar", "(?i)sql": None, "ab?cde": "cde", "[a[b]]cde": None, "a|b": None}
    df = spark.createDataFrame([(x,) for x in given], "v string")
    assert dict(df.select("v", sc._required(F.col("v"))).collect()) == given


def test_counts_of_regexes_that_find_the_same(spark, sf):
    """Rules meet kinds of matches, not matches, and the counts are those of the issues."""
    corpus = V.code_corpus(spark, sf, "javascript").unionByName(V.code_corpus(spark, sf, "python"))
    some = [*REGEXES, *(f"^eval(x{n})?$" for n in range(50))]
    table = rules(spark, some)
    counts = sc.rule_issue_counts(corpus, table)
    issues = sc.scan_all(corpus, table).groupBy("rule_no", "rule_id", "severity")
    want = issues.agg(F.count("*").alias("issues"), F.countDistinct("file_path").alias("files"))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.collect()))
    keyed, searches, wanted, needs = sc._prepared(table, spark)
    kinds = sc._kinds(sc.facts_of(corpus, wanted, (), needs), keyed)
    names = kinds.select("language", "caps").distinct().count()
    assert names < 20 < kinds.agg(F.sum("n")).first()[0]
    assert sc._answered(kinds, searches).count() <= names * len(some)
