"""Text operators against brute force, and their defined edge cases."""

import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lintlake.llm import brown, licenses, linedup, packing, simhash, templates, toxicity

DOC = "doc_id bigint, text string, source string, extra int"
LONG = " ".join(f"word{i % 977} item{i}" for i in range(30_000))


def rows(spark, texts):
    return spark.createDataFrame(
        [(i, t, f"s{i % 2}", 1) for i, t in enumerate(texts)], DOC
    )


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_fingerprints_and_components_by_brute_force(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    extra = [(9001, None), (9002, ""), (9003, LONG), (9003, LONG), (None, "one two"), (9004, "one two")]
    more = spark.createDataFrame(extra, "doc_id bigint, text string")
    found = simhash.near_duplicates(docs.select("doc_id", "text").union(more)).collect()
    assert len(found) == len(texts) + len(extra)

    def plain(text):
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
        # Bytes from the lowest on, as numpy keeps an unsigned number.
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    all_rows = [*texts.items(), *extra]
    prints = {(i, t): plain(t) for i, t in all_rows}
    fps = sorted(set(prints.values()))
    links = [(a, b) for n, a in enumerate(fps) for b in fps[:n] if bin(a ^ b).count("1") <= 2]
    group = {f: f for f in fps}

    def top(f):
        while group[f] != f:
            f = group[f]
        return f

    for a, b in links:
        group[top(a)] = top(b)
    low = {}
    for (i, _), f in prints.items():
        if i is not None:
            low[top(f)] = min(i, low.get(top(f), i))
    want = {(i, f"{f:016x}", low[top(f)]) for (i, _), f in prints.items()}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in found} == want


def test_pivots_never_discard_a_link():
    rng = np.random.default_rng(1)
    pivots = simhash.references()
    for _ in range(300):
        a = int(rng.integers(1 << 63))
        b = a ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64)))
        for p in pivots:
            assert abs(bin(a ^ p).count("1") - bin(b ^ p).count("1")) <= 2


def test_exploded_fingerprints_are_not_broadcast(spark, tmp_path):
    """28 rows of a fingerprint, which Spark sizes as one."""
    prints = [(i, xxhash.xxh64_intdigest(b"%d" % i) - (1 << 63)) for i in range(2000)]
    given = spark.createDataFrame(prints, "doc_id bigint, fp bigint")
    given.write.parquet(str(tmp_path / "prints"))
    found = simhash.links(spark.read.parquet(str(tmp_path / "prints")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    a = prints[0][1]
    near = spark.createDataFrame([(1, a), (2, a ^ 1), (3, a ^ 7)], "doc_id bigint, fp bigint")
    ends = [{r.a, r.b} for r in simhash.links(near).collect()]
    assert len(ends) == 2 and {a, a ^ 1} in ends and {a ^ 1, a ^ 7} in ends


def edited(text, share, seed):
    rng = np.random.default_rng(seed)
    words = text.split()
    for i in rng.choice(len(words), max(1, int(len(words) * share)), replace=False):
        words[i] = f"edit{seed}x{i}"
    return " ".join(words)


def test_similar_texts_by_brute_force(spark, docs):
    """Near copies of many degrees, hubs and chains, copies, short, empty and very long texts."""
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    base = " ".join(f"w{i % 389} v{i}" for i in range(150))
    texts += [edited(base, k / 400, k) for k in range(20)] + [base.upper(), base]
    texts += [edited(t, 0.03, k) for k, t in enumerate(texts[:40]) if t and len(t.split()) > 30]
    texts += [LONG, edited(LONG, 0.01, 3), LONG, None, "", "  ", "one two", "One  two", "one three"]
    df = rows(spark, texts)
    more = spark.createDataFrame([(None, "one two", "s", 1), (0, texts[0], "s", 1)], DOC)
    got = simhash.similar_texts(df.union(more)).collect()
    assert len(got) == len(texts) + 2

    def shingles(text):
        w = (text or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            if s and t and min(len(s), len(t)) >= 0.8 * max(len(s), len(t)):
                if len(s & t) >= 0.8 * len(s | t):
                    a, b = sorted((top(i), top(j)))
                    group[b] = a
    want = {i: top(i) for i in range(len(texts))}
    assert sum(i != r for i, r in want.items()) > 25
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    lone = [r.component_id for r in got if r.doc_id is None]
    assert lone == [want[texts.index("one two")]]
    assert simhash.similar_texts(df.limit(0)).count() == 0


def test_similar_texts_with_repeats_and_tails(spark):
    """Repeated lines turn whole fingerprints; only the sets of shingles decide."""
    texts = []
    for n, line, times in ((200, 30, 10), (300, 12, 60), (400, 20, 40), (120, 9, 80)):
        for k in range(10):
            body = " ".join(f"b{n}x{k}y{i}" for i in range(n))
            again = " ".join(f"r{n}x{k}y{i}" for i in range(line))
            texts += [f"{body} {again}", " ".join([body, *[again] * times])]
    for n in (100, 400, 1000):
        for k in range(10):
            body = " ".join(f"t{n}x{k}y{i}" for i in range(n))
            texts += [body, body + " " + " ".join(f"u{n}x{k}y{i}" for i in range(n // 5))]
    n = len(texts)
    words = [t.split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    for i in range(0, n, 2):
        a, b = sets[i], sets[i + 1]
        assert len(a & b) >= 0.8 * len(a | b)
    far = [simhash.fingerprint(t.encode().split()) for t in texts]
    assert sum(bin(far[i] ^ far[i + 1]).count("1") > 16 for i in range(0, n, 2)) > 20
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(rows(spark, texts)).collect()}
    assert got == {i: i - i % 2 for i in range(n)}


def test_pivot_distances_never_discard_a_similar_pair():
    rng = np.random.default_rng(6)
    for size in (1, 4, 9, 45, 300, 5000):
        for _ in range(50):
            every = np.unique(rng.integers(1 << 63, size=size, dtype=np.uint64))
            cut = int(rng.integers(len(every) // 5 + 1))
            a, b = every[cut // 2 :], every[: len(every) - (cut - cut // 2)]
            most = (len(a) + len(b)) / 9 + 0.5
            apart = np.abs(simhash.pivot_distances(a) - simhash.pivot_distances(b))
            assert (apart <= most).all()


def test_brown_counts_and_scores(spark, docs):
    got = brown.score_texts(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    count = {}
    for i, t in texts.items():
        if not held[i]:
            for w in brown.tokens_of(t):
                count[w] = count.get(w, 0) + 1
    n = sum(count.values())
    for r in got:
        words = brown.tokens_of(texts[r.doc_id])
        base = sum(np.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (len(count) + 1))) for w in words)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(words), n)
        assert r.n_known == sum(w in count for w in words)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
    assert len(got) == len(texts)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_brown_model_is_a_distribution():
    rng = np.random.default_rng(0)
    table, tokens, types = rng.integers(0, 9, (4, 4)), rng.integers(5, 50, 4), rng.integers(1, 5, 4)
    steps, mass = brown._log_model(table.astype(float), tokens.astype(float), types.astype(float))
    assert np.allclose((10**steps).sum(1), 1)
    known, unseen = tokens + brown.ADD * types, brown.ADD
    assert np.allclose((known + unseen) / 10**mass, 1)


def test_brown_words_below_the_share_move_by_their_contexts(spark, monkeypatch):
    """Words of one ending, so of one pool, that stand between different words."""
    monkeypatch.setattr(brown, "OWN_SHARE", 16)
    monkeypatch.setattr(brown, "SHARE_WORDS", 50)  # several shares
    rng = np.random.default_rng(3)
    near = [[f"l{x} {x}{i}zzz r{x}" for i in range(60) for _ in range(8)] for x in "ab"]
    texts = [" ".join(rng.permutation(lines)[:400]) for lines in near for _ in range(4)]
    asked = [f"l{x} {y}{i}zzz r{x}" for i in range(60) for x in "ab" for y in "ab"]
    found = brown.score_texts(rows(spark, texts + asked)).collect()
    score = [r.score for r in sorted(found, key=lambda r: r.doc_id)][len(texts) :]
    base = [r.base_score for r in sorted(found, key=lambda r: r.doc_id)][len(texts) :]
    gain = np.subtract(score, base).reshape(60, 2, 2)  # word, words beside it, kind of word
    assert (gain[:, 0, 0] > gain[:, 0, 1] + 0.2).mean() > 0.9
    assert (gain[:, 1, 1] > gain[:, 1, 0] + 0.2).mean() > 0.9


def test_brown_shares_do_not_crowd():
    """Words alike in all shares: each share leaves room for what the others move."""
    k = brown.CLASSES + 1
    table = np.full((k, k), 100.0)
    home, beside = np.arange(320) % brown.CLASSES, np.zeros((320, k))
    beside[:, 7] = 6
    alone = brown.move_share(beside, beside, home, table, 1)
    assert (brown.move_share(beside, beside, home, table, 50) != home).sum() <= (alone != home).sum()


def test_brown_edge_rows(spark):
    df = rows(spark, [None, "", "a a b", "a a b", LONG])
    got = {r.doc_id: r for r in brown.score_texts(df).collect()}
    assert got[0].n_tokens == got[1].n_tokens == 1
    assert got[4].n_tokens == 60_001
    assert brown.score_texts(df.limit(0)).count() == 0


def test_lines_by_host_share(spark):
    texts = [f"Share this\n  page {i}  \n\nbody {i}" for i in range(20)] + [None, "", "Share this"]
    df = rows(spark, [*texts, *["copied line\nother copied line"] * 12])
    out = {r.doc_id: r for r in linedup.dedup_lines(df).collect()}
    assert out[3].text == "  page 3  \n\nbody 3" and out[3].n_dropped == 1
    assert out[20].text is None and out[21].text == "" and out[22].text == ""
    assert all(out[i].text == "copied line\nother copied line" for i in range(23, 35))
    assert out[5].extra == 1
    assert linedup.dedup_lines(df.limit(0)).count() == 0


def test_lines_on_few_of_many_pages(spark):
    """Boilerplate on 2% of a host's pages goes; a line on four pages stays."""
    texts = [f"body {i}\nown {i}" for i in range(400)]
    for i in range(0, 400, 50):
        texts[i] += "\nSubscribe to our letter"
    for i in range(1, 400, 100):
        texts[i] += "\nSeen four times"
    df = rows(spark, texts).withColumn("source", F.lit("one"))
    out = {r.doc_id: r for r in linedup.dedup_lines(df).collect()}
    assert {i for i in out if out[i].n_dropped} == set(range(0, 400, 50))
    assert out[50].text == "body 50\nown 50"
    assert out[101].text.endswith("Seen four times")


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    special = "a <|endoftext|> b"
    more = spark.createDataFrame(
        [(9001, None), (9002, ""), (9003, LONG), (9003, LONG), (9004, special)],
        "doc_id bigint, text string",
    )
    df = docs.select("doc_id", "text").union(more)
    coder = Tokenizer.from_file(packing.vocabulary("byte_bpe_50k.json"))
    pieces = packing.pack(df)
    got = pieces.collect()
    want = {r.doc_id: [*coder.encode(r.text or "", add_special_tokens=False).ids, 1] for r in df.collect()}
    for r in got:
        ids = np.array(want[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes()
        assert (zlib.crc32(ids), len(want[r.doc_id])) == (r.ids_crc32, r.doc_tokens)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for number, parts in by.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or number == max(by)
    assert sum(r.length for r in got) == sum(len(want[r.doc_id]) for r in df.collect())
    sizes = {r.sequence_id: len(r.ids) for r in packing.sequences(pieces).collect()}
    assert set(sizes.values()) <= {2048, *(1 << k for k in range(12))}


def test_license_places_by_brute_force(spark, docs):
    index = licenses.Index(licenses.TEMPLATES)
    grant = licenses.TEMPLATES["mit-grant"].split()
    changed = " ".join([*grant[:20], "altered", *grant[21:]])
    texts = [r.text for r in docs.collect()]
    texts += [None, "", "# " + "\n# ".join(grant), "x y " + changed + " z", LONG + " " + changed]
    df = rows(spark, texts)
    got = {(r.doc_id, r.license) for r in licenses.scan_licenses(df).collect()}
    want = set()
    for i, text in enumerate(texts):
        shingles = licenses.shingles(licenses.words_of(text))
        place = {s for s in shingles}
        for name, own in index.sets.items():
            if len(own & place) < 0.8 * len(own):
                continue
            n = len(own)
            spans = (set(shingles[s : s + n + n // 2 + 2]) for s in range(len(shingles)))
            if any(len(own & w) >= 0.8 * n for w in spans):
                want.add((i, name))
    assert got == want
    assert (len(texts) - 1, "mit-grant") in got
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_leaks_and_changed_numbers(spark):
    item = "A train leaves Paris at 9 and travels 120 km to Lyon in 2 hours how fast is the train"
    changed = item.replace("120", "300").replace("Paris", "Berlin").replace("km", "miles")
    mixed = "A and 9 and 9 with 120 km then 9 and more 9 words follow here until the end of it"
    items = spark.createDataFrame(
        [(1, item), (2, mixed), (3, "only four words here"), (4, None), (5, "")],
        "item_id bigint, text string",
    )
    texts = [
        f"Before it. {item}. After it.",
        f"words before\n{changed} words after",
        mixed.replace("9 with", "7 with"),
        None,
        "",
        "a clean text about a train that leaves somewhere else and travels far",
        LONG + " " + item,
        "so only four words here indeed",
    ]
    found = templates.find_leaks(rows(spark, texts), items).collect()
    got = {(r.doc_id, r.item_id): r.same_slots for r in found}
    assert got == {(0, 1): True, (1, 1): False, (6, 1): True, (7, 3): True}
    kept = templates.without_leaks(rows(spark, texts), items)
    assert {r.doc_id for r in kept.collect()} == {2, 3, 4, 5}
    assert templates.find_leaks(rows(spark, texts), items.limit(0)).count() == 0


def test_verbatim_leaks_whatever_their_slots(spark):
    quote = "The farmer has 9 hens and sells 9 of them for money every single week"
    items = spark.createDataFrame(
        [
            (1, "who wrote Hamlet in 1600"),
            (2, "what is 17 25 9 3"),
            (3, "add 1 2 3 4 5 6 7 8 9 10 11 12 13"),
            (4, quote + " until 9 foxes come and take 9 hens away"),
        ],
        "item_id bigint, text string",
    )
    texts = [
        "he asked who wrote Hamlet in 1600 again",
        "tell me what is 17 25 9 3 please",
        "now add 1 2 3 4 5 6 7 8 9 10 11 12 13 or so",
        quote + " because 7 wolves come and take 5 hens away",
        quote + " 4 7 or not",
        "he asked who wrote Faust in 1808 again",
        "tell me what is 18 26 8 4 please",
        "now add 21 32 43 54 65 76 87 98 19 20 31 42 53 or so",
        quote.replace("sells 9", "sells 7") + " until 5 foxes come and take 3 hens away",
    ]
    found = templates.find_leaks(rows(spark, texts), items).collect()
    got = {(r.doc_id, r.item_id): (r.run, r.same_slots) for r in found}
    assert got == {
        (0, 1): (5, True),
        (1, 2): (6, True),
        (2, 3): (14, True),
        (3, 4): (15, True),
        (4, 4): (15, True),
    }


def test_copies_are_found_whatever_looks_like_a_name(spark):
    """Against brute force: every text with a whole item, word for word, at any place."""
    rng = np.random.default_rng(11)
    vocabulary = ["Which", "river", "Paris", "runs", "9", "17", "km", "old", "the", "Town"]
    draw = lambda n: " ".join(rng.choice(vocabulary, n))
    bench = ["Which river runs through the old town", *(draw(n) for n in (5, 7, 9, 11, 12, 14, 20))]
    bench.append(" ".join(map(str, range(1, 13))))
    items = spark.createDataFrame(list(enumerate(bench)), "item_id bigint, text string")
    texts = [" ".join(map(str, range(500, 800)))]  # numbers only: no copy
    for k in range(80):
        middle = bench[k % len(bench)] if k % 3 else draw(8)
        texts.append(f"{draw(int(rng.integers(0, 9)))} {middle} {draw(int(rng.integers(0, 9)))}")
    docs = rows(spark, texts).selectExpr("*", "1 AS leak_id", "2 AS leak_key", "3 AS d")
    found = templates.find_leaks(docs, items).collect()
    same = {(r.doc_id, r.item_id) for r in found if r.same_slots}
    flat = [f" {' '.join(t.lower().split())} " for t in texts]
    want = {(d, i) for d, t in enumerate(flat) for i, b in enumerate(bench) if f" {b.lower()} " in t}
    assert len(want) > 40 and want <= same
    assert not any(r.doc_id == 0 for r in found)
    kept = templates.without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert not {r.doc_id for r in kept.collect()} & {d for d, _ in want}


def test_every_planted_passage_is_found(spark, docs, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    flat = lambda t: " ".join((t or "").lower().split())
    items = [flat(r.text) for r in bench.collect()]
    want = {r.doc_id for r in docs.collect() if any(i in flat(r.text) for i in items)}
    got = {r.doc_id for r in templates.find_leaks(docs, bench).collect()}
    assert want <= got and len(got - want) <= len(want)


def test_toxicity_edges_and_separation(spark):
    rng = np.random.default_rng(5)
    calm = [f"calm{c}" for c in "abcdefghijklmnop"]
    texts, marks = [], []
    for i in range(300):
        words = list(rng.choice(calm, 40))
        if i % 3 == 0:
            words[5] = f"vilehat{rng.choice(list('xyzqkw'))}"
        texts.append(" ".join(words))
        marks.append(int(i % 3 == 0))
    texts += [None, "", LONG]
    df = rows(spark, texts)
    labels = spark.createDataFrame(
        [*enumerate(marks), (None, 1), (1, None)], "doc_id bigint, toxic int"
    )
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, labels).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in range(300) if got[i].held_out]
    assert np.mean([got[i].predicted == marks[i] for i in held]) > 0.95
    assert got[300].score == got[301].score
    none = toxicity.score_toxicity(df, labels.limit(0)).agg(F.count_distinct("score")).first()
    assert none[0] == 1


def test_pipeline_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    done = corpus_pipeline.drop_lines(spark, docs, sf)
    assert done.columns == docs.columns and done.count() == docs.count()
    kept = corpus_pipeline.drop_copies(spark, done, sf)
    assert kept.columns == docs.columns
    found = simhash.similar_texts(done).where("doc_id = component_id")
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in found.collect()}
    assert kept.where("text <> ''").groupBy("text").count().where("count > 1").isEmpty()


def test_copies_by_fingerprint_go_as_well(spark, sf):
    """A line that fills two texts makes their fingerprints near, though most shingles differ."""
    line = "the quick brown fox jumps over one lazy dog and runs "
    a, b = (line * 80 + " ".join(f"{x}{n}" for n in range(12)) for x in "ab")
    prints = [simhash.fingerprint(t.split()) for t in (a.encode(), b.encode())]
    assert (prints[0] ^ prints[1]).bit_count() <= simhash.MAX_BITS
    shingles = [set(simhash.word_hashes(t.encode().split())) for t in (a, b)]
    assert len(shingles[0] & shingles[1]) < simhash.SIMILARITY * len(shingles[0] | shingles[1])
    near = " ".join(f"w{n}" for n in range(100))
    rows = [(5, a), (3, b), (7, near), (8, near + " z"), (9, ""), (10, None), (11, " "), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = corpus_pipeline.drop_copies(spark, docs, sf)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 7, 9, 10, 11]


def test_brown_texts_are_cut_into_words_once(spark, docs, monkeypatch):
    monkeypatch.setattr(brown, "BLOCK_CHARS", 2000)  # many blocks, of which texts are part
    coded = brown._coded(docs, "doc_id", "text").collect()
    listed, texts = {}, {r.doc_id: r.text for r in docs.collect()}
    for r in coded:
        if r.word is not None:
            listed.setdefault(r.block, {})[r.place] = bytes(r.word)
    assert len(listed) > 1 and all(sorted(w) == list(range(len(w))) for w in listed.values())
    seen = [r for r in coded if r.ids is not None]
    for r in seen:
        at = np.frombuffer(r.ids, dtype=np.int32)
        assert [listed[r.block][i] for i in at] == brown.tokens_of(texts[r.doc_id])
    assert sorted(r.doc_id for r in seen) == sorted(texts)
