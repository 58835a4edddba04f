"""Resampling, repeated passages and the divergence audit against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lintlake.llm import divergence, repeats, resample
from lintlake.llm.spans import blocks, utf8, word_spans

DOC = "doc_id bigint, text string, lang string, source string, score string, rank int, h string, t1 int"
LONG = " ".join(f"word{i % 977} item{i}" for i in range(30_000))
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    """Rows of id, text, lang, source; the other columns have names the operators use inside."""
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], DOC)


@pytest.fixture(scope="session")
def rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    real = [(r.doc_id, r.text, r.lang, r.source) for r in docs]
    passage = " ".join(f"p{i}" for i in range(70))
    longest = "é" * 5000 + " " + "x" * 40_000 + " end"
    more = [
        (9001, None, "en", "src0"),
        (9002, "", None, None),
        (9003, LONG, "en", "src0"),
        (9003, LONG, "en", "src0"),
        (None, LONG + " more", "en", "src1"),
        (9004, "lead " + passage + " tail", "en", None),
        (9005, passage + " " + passage, "de", "src2"),
        (9006, " ".join(["same"] * 400), "xx", "src9"),
        (9007, " ".join(["same"] * 120), "xx", "src8"),
        (9008, longest, "en", "src3"),
        (9009, real[0][1], "fr", "src4"),
        (9010, "Ünïcode ÀÉ ΑΒΓ Zz-Zz_9 \u0000 a b", "en", "src5"),
    ]
    return real + more


# --- resampling ----------------------------------------------------------------------


def test_span_crcs_are_crc32():
    random.seed(3)
    data = np.frombuffer(random.randbytes(200_000), np.uint8)
    size = np.array([random.choice([1, 2, 63, 64, 65, 128, 129, 255, 256, 257, 9000]) for _ in range(800)])
    start = np.array([random.randrange(len(data) - 9000) for _ in size])
    found = resample.span_crcs(data, start, start + size)
    assert found.tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(start, size)]
    assert len(resample.span_crcs(data, start[:0], start[:0])) == 0


def test_word_spans_do_not_cross_rows():
    data, offsets = utf8(pa.array(["ab", "cd", None, "", " e f"]).slice(1))
    starts, ends, first = word_spans(data, offsets, repeats.INSIDE)
    assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == [b"cd", b"e", b"f"]
    assert first.tolist() == [0, 1, 1, 1, 3]
    assert list(blocks(np.array([5, 5, 20, 1]), 10)) == [(0, 2), (2, 3), (3, 4)]


def plain_resample(docs, target, max_run, buckets, least, percent, seed):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))
        runs = [" ".join(words[i : i + n]) for n in range(1, max_run + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(x.encode()) % buckets for x in runs]

    own = [features(t) for _, t in docs]
    s = Counter(b for _, f in own for b in f)
    t = Counter(b for x in target for b in features(x)[1])
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all)))
    out = []
    for (i, _), (n, f) in zip(docs, own):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, n])
    able = sorted(
        (r for r in out if r[4] >= least),
        key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]),
    )
    rank = Counter()
    drawn = able[: percent * len(able) // 100]
    places = defaultdict(list)
    for k, r in enumerate(drawn, 1):
        places[tuple(r)].append(k)
    result = []
    for r in out:
        left = places[tuple(r)]
        result.append((*r[:4], left.pop(0) if left else None))
    assert not rank
    return Counter(result)


@pytest.mark.parametrize("max_run, buckets, percent", [(1, 10_000, 10), (3, 500, 60)])
def test_resample_by_brute_force(spark, sf, rows, max_run, buckets, percent):
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = resample.resample(
        table(spark, rows), target, max_run=max_run, buckets=buckets, percent=percent
    ).collect()
    want = plain_resample(
        [r[:2] for r in rows], [r.text for r in target.collect()], max_run, buckets, 20, percent, "2024"
    )
    assert Counter(map(tuple, found)) == want


def test_resample_of_empty_tables(spark, sf, rows):
    docs = table(spark, rows)
    assert resample.resample(docs.limit(0), docs).collect() == []
    found = resample.resample(docs, docs.limit(0), percent=0).collect()
    assert len(found) == len(rows) and all(r["rank"] is None for r in found)


# --- repeated passages ---------------------------------------------------------------


def plain_repeats(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    low = {}
    for r, w in zip(rows, words):
        if r[0] is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                low[key] = min(low.get(key, r[0]), r[0])
    out = []
    for r, w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1) if r[0] is not None else ():
            if low[tuple(w[i : i + window])] < r[0]:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), kept))
    return Counter(out)


@pytest.mark.parametrize("window", [50, 20, 3])
def test_repeats_by_brute_force(spark, rows, window):
    some = [r for r in rows if r[1] is None or len(r[1]) < 20_000 or r[0] in (9003, 9008, None)]
    if window == 3:
        some = [(i, (t or "")[:1500], *x) for i, t, *x in some]
    found = repeats.without_repeats(table(spark, some), window).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found) == plain_repeats(some, window)
    for r in found:
        assert r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest()
    assert any(r.n_removed for r in found)


def test_repeats_edge_cases(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = [(5, text), (5, text), (7, text), (None, text), (9, text + " x"), (11, "w0 w1"), (3, None)]
    found = repeats.without_repeats(table(spark, [(*d, None, None) for d in docs])).collect()
    removed = sorted((r.doc_id or 0, r.n_removed) for r in found)
    assert removed == [(0, 0), (3, 0), (5, 0), (5, 0), (7, 60), (9, 60), (11, 0)]
    assert repeats.without_repeats(table(spark, []), 50).collect() == []
    assert repeats.lengths(50) == [25, 50] and repeats.lengths(1) == [1]


def test_least_is_the_first_minimum():
    random.seed(1)
    values = np.array([random.choice([3 << 40, 5 << 40, 7 << 40]) for _ in range(200)], dtype=np.uint64)
    for width in (1, 2, 26):
        want = [i + int(np.argmin(values[i : i + width])) for i in range(len(values) - width + 1)]
        assert repeats.least(values, width).tolist() == want


# --- divergence ----------------------------------------------------------------------


def plain_audit(rows, least, top):
    terms = [
        re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate(AZ)) for r in rows
    ]
    keys = [(r[2] or "", r[3] or "") for r in rows]
    held, count = Counter(), Counter()
    for (lang, source), t in zip(keys, terms):
        held.update((lang, x) for x in set(t))
        count.update((lang, source, x) for x in t)
    kept = defaultdict(list)
    for (lang, x), n in held.items():
        if n >= least:
            kept[lang].append(x)
    groups = defaultdict(set)
    for lang, source in keys:
        groups[lang].add(source)
    out = []

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    for lang, sources in groups.items():
        v = len(kept[lang])
        total = {s: sum(count[lang, s, x] for x in kept[lang]) for s in sources}
        n_all = sum(total.values())
        share = {
            (s, x): 1 + 10**9 * (count[lang, s, x] + 2) // (total[s] + 2 * v)
            for s in sources
            for x in kept[lang]
        }
        base = {
            x: 1 + 10**9 * (sum(count[lang, s, x] for s in sources) + 2) // (n_all + 2 * v)
            for x in kept[lang]
        }
        for s in sources:
            pair = [(-sum(f(share[s, x], share[o, x]) for x in kept[lang]), o) for o in sources - {s}]
            pair.sort(key=lambda y: (y[0], y[1].encode()))
            out += [(lang, s, "pair", o, -n, k) for k, (n, o) in enumerate(pair, 1)]
            above = [
                (-f(share[s, x], base[x]), x)
                for x in kept[lang]
                if count[lang, s, x] and share[s, x] > base[x]
            ]
            above.sort(key=lambda y: (y[0], y[1].encode()))
            out += [(lang, s, "term", x, -n, k) for k, (n, x) in enumerate(above[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least, top, pending, held", [(10, 10, 4096, 300_000), (1, 3, 8, 50), (10**6, 10, 8, 9)])
def test_audit_by_brute_force(spark, rows, monkeypatch, least, top, pending, held):
    monkeypatch.setattr(divergence, "PENDING", pending)
    monkeypatch.setattr(divergence, "HELD", held)
    some = [r for r in rows if r[0] != 9003]
    found = divergence.audit(table(spark, some), least, top).collect()
    assert sorted(map(tuple, found)) == plain_audit(some, least, top)


def test_audit_of_an_empty_table(spark):
    assert divergence.audit(table(spark, [])).collect() == []


def test_skyband_keeps_all_with_few_dominators():
    rng = np.random.default_rng(5)
    for size, k in ((1, 1), (40, 2), (700, 10)):
        n, lang_n = rng.integers(1, 12, size), rng.integers(1, 15, size)
        terms = np.empty(size, dtype=object)
        terms[:] = [b"t%03d" % i for i in rng.permutation(size)]
        over = [
            sum(n[j] >= n[i] and lang_n[j] <= lang_n[i] and terms[j] < terms[i] for j in range(size))
            for i in range(size)
        ]
        want = [i for i in range(size) if over[i] < k]
        assert sorted(divergence.skyband(n, lang_n, terms, k).tolist()) == want


def test_share_is_exact():
    counts = np.array([0, 1, 7, 10**12, 3 * 10**14], dtype=np.int64)
    for total in (3, 10**13 + 7, 9 * 10**14):
        want = [1 + 10**9 * (int(c) + 2) // total for c in counts if c + 2 <= total]
        assert divergence.share(counts[: len(want)], total).tolist() == want
