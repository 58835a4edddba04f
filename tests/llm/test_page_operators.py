"""Page, URL and vector operators against brute force, and their edge cases."""

import math

import duckdb
import numpy as np
import pytest

from lintlake.llm import pcadedup, queries, sitetree, urlrules


def test_urls_by_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    odd = [
        None, "", "no scheme", "http://NET/x", "http://a.net", "http://a.NET/?q", "http://xnet/",
        "http://a.Example.NET/en/9", "http://example.com/de/", "http://b.org/fr/x#y", "x://",
        "http://a.net/p://b.org/fr/", "http://example.net/en", "http://example.com./de/",
    ]
    odd += odd[:3]
    more = spark.createDataFrame([(9000 + i, u) for i, u in enumerate(odd)], "page_id bigint, url string")

    def judge(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, rest = rest[:cut].lower(), rest[cut:]
            path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        fits = []
        for verdict, rule in urlrules.RULES:
            h, p = rule.split("/", 1)
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append((len(rule), rule, verdict))
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    every = pages.union(more)
    got = [
        (r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlrules.judge_urls(every).collect()
    ]
    want = [(r.page_id, *judge(r.url)) for r in every.collect()]
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert urlrules.judge_urls(every.limit(0)).count() == 0


def test_nested_rules_keep_a_stack(spark):
    rules = [("block", "com/"), ("allow", "a.com/"), ("block", "x.a.com/"), ("allow", "x.a.com/ok/")]
    urls = ["http://z.com/", "http://a.com/", "http://q.a.com/", "http://x.a.com/", "http://w.x.a.com/ok/1", "http://b.net/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: r.rule for r in urlrules.judge_urls(df, rules).collect()}
    assert got == {0: "com/", 1: "a.com/", 2: "a.com/", 3: "x.a.com/", 4: "x.a.com/ok/", 5: None}


@pytest.mark.parametrize("name", ["op3_line_dedup", "op8_url_rules", "op9_pca_dedup"])
def test_sql_gives_the_same_rows(spark, sf, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = db.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, rows))


def test_vectors_by_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    vectors = [(c + rng.normal(size=24) * s).tolist() for c in centres for s in (0, 0.05, 0.2, 0.35, 0.4)]
    vectors += [vectors[0]] * 3 + [[0.0] * 24, None, [], [math.nan] * 24, [None] * 24, [1e300] * 24, [1.0, 2.0]]
    vectors = [v if v is None else [None if x is None else float(x) for x in v] for v in vectors]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r for r in pcadedup.near_duplicates(df).collect()}
    good = {
        i: np.array(v) / np.linalg.norm(np.array(v) / max(np.abs(v))) / max(np.abs(v))
        for i, v in enumerate(vectors)
        if v and None not in v and np.isfinite(v).all() and any(v)
    }
    near = {
        i: {j for j in good if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.9}
        for i in good
    }
    root = {}
    for start in range(len(vectors)):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = start
                todo += near.get(x, ())
    for i in range(len(vectors)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (
            len(near.get(i, ())), root[i], root[i] == i
        )
    assert pcadedup.near_duplicates(df.limit(0)).count() == 0


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 40)) * np.linspace(3, 0.2, 40)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = pcadedup.close_pairs(x, x, 0.6, step=8)
    want = {tuple(p) for p in np.argwhere(x @ x.T >= 0.6)}
    assert want <= set(zip(i.tolist(), j.tolist()))


def test_vectors_move_in_few_bytes(spark, monkeypatch):
    """Single precision where it is exact, once for each tile of the other side."""
    rng = np.random.default_rng(6)
    x = (np.repeat(rng.normal(size=(9, 8)), 5, axis=0) + rng.normal(size=(45, 8)) * 0.2).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    given = [(8, i, 1, v.astype(float).tobytes()) for i, v in enumerate(x)]
    given.append((8, 45, 1, (x[0].astype(float) + 1e-12).tobytes()))
    dealt = spark.createDataFrame(given, "dim bigint, cls bigint, n bigint, vec binary")
    moved = {r.cls: bytes(r.vec) for r in pcadedup._cells(dealt, {8: np.eye(8)}, 0.5).collect()}
    for cls, vec in moved.items():
        assert len(vec) == (32 if cls < 45 else 64)
        assert pcadedup._unpacked([vec], 8)[0].tobytes() == given[cls][3]
    assert pcadedup.tile_rows(10**7, 64) == 32_768 and pcadedup.tile_rows(100, 64) == pcadedup.TILE
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = [int(n) - 1 for n in (unit @ unit.T >= 0.9).sum(1)]
    for tile, most in ((2, 512), (2, 1 << 20), (7, 64)):  # groups of several tiles, and of one
        monkeypatch.setattr(pcadedup, "TILE", tile)
        monkeypatch.setattr(pcadedup, "TILE_BYTES", most)
        got = pcadedup.near_duplicates(df).orderBy("vec_id").collect()
        assert [r.n_links for r in got] == want


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">Menu</a></ul></nav>
<div class="ad">Buy &lt;now&gt;</div><article><h1>Head &amp; line</h1><p><b>One
two<br>three<p>Four &quot;five&quot; a < b<div class="share">Share it</div>
<form><p>Mail<input></form><section class="comments"><p>First!</section></article>
<aside>Side</aside><footer>&copy; Site</footer><script>var t="</p>";</script>"""


def test_article_only():
    assert sitetree.main_text(PAGE, set()) == 'Head & line\nOne two three\nFour "five" a < b'
    assert sitetree.main_text(None, set()) == sitetree.main_text("", set()) == ""
    assert sitetree.main_text("plain  text", set()) == "plain text"


def test_site_tree_removes_what_repeats(spark):
    def page(i):
        return f"<html><body><div><p>Same teaser on every page</p></div><div class=b><p>Own text {i} here</p></div></body></html>"

    data = [(i, "http://h.org/x", page(i)) for i in range(30)]
    data += [(90, "http://one.org/", page(5)), (91, None, None), (92, None, ""), (93, "u", PAGE), (93, "u", PAGE)]
    df = spark.createDataFrame(data, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in sitetree.extract(df).collect()}
    assert got[7].text == "Own text 7 here" and got[7].n_chars == 15
    assert got[90].text == "Same teaser on every page\nOwn text 5 here"
    assert got[91].text == got[92].text == ""
    assert got[93].text.startswith("Head & line")
    assert sitetree.extract(df).count() == len(data)
    assert sitetree.extract(df.limit(0)).count() == 0


def test_copies_are_one_page_of_the_tree(spark):
    def page(i):
        return f"<html><body><div class=a><p>Head {i}</p></div><div><p>Own text {i}</p></div></body></html>"

    classed = "<article><div class=body><p>Classed text</p></div></article>"
    data = [(0, "http://two.org/", page(0)), (0, "http://two.org/", page(0))]
    data += [(10 + i, "http://copies.org/", page(1)) for i in range(20)]
    data += [(40 + i, "http://few.org/", page(i % 2)) for i in range(20)]
    data += [(70, "http://c.org/", classed), (70, "http://c.org/", classed)]
    data += [(80 + i, None, page(3)) for i in range(3)]
    df = spark.createDataFrame(data, "page_id bigint, url string, html string")
    got = sitetree.extract(df).collect()
    assert len(got) == len(data)
    text = {r.page_id: r.text for r in got}
    assert text[0] == "Head 0\nOwn text 0"
    assert {text[10 + i] for i in range(20)} == {"Head 1\nOwn text 1"}
    assert [text[40 + i] for i in range(20)] == ["Head 0\nOwn text 0", "Head 1\nOwn text 1"] * 10
    assert text[70] == "Classed text"
    assert {text[80 + i] for i in range(3)} == {"Head 3\nOwn text 3"}


def test_custom_tags_and_unclosed_quotes():
    from lintlake.llm.sitetree import main_text

    assert main_text("<style-guide>x</style-guide><p>after</p><style>y</style>", set()) == "x\nafter"
    assert main_text('<p class="x>hello', set()) == "hello"
    assert main_text("<p title='b>c'>d</p>", set()) == "d"
