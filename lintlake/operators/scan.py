"""Facts and issues: one pass over the corpus for all rules, without a shuffle.

A file is tokenized once inside its row, all wanted shapes are looked up in the token
array, and only matches leave the row.  Files without any of the texts the rules need
are dropped before they are tokenized.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake import schemas
from lintlake.operators import shapes as sh
from lintlake.operators import tokens as tk
from lintlake.operators.shapes import Condition
from lintlake.sources.rules import Rule, RuleSet
from lintlake.sources.storage import shared_folder, stored

_BLOCK = 128
_POINTS = "array<struct<line:int,col:int>>"


# --- positions ---------------------------------------------------------------------


def _advance(line: Column, col: Column, text: Column) -> tuple[Column, Column]:
    """Line and byte column after ``text`` when it starts at (line, col)."""
    nl = tk.newlines(text)
    tail = tk.last_line_bytes(text)
    return line + nl, F.when(nl == 0, col + tail).otherwise(tail + 1)


def _points() -> str:
    """SQL over tok and hits: line and column of the start of each hit.

    Each piece of text between two hits is measured once, then summed up in blocks, so the
    work grows with the text and not with text x hits.
    """

    def named(var: str, value: str, body: str) -> str:
        return f"get(transform(array({value}), {var} -> {body}), 0)"

    before = "coalesce(get(a, k - 1), 0)"
    pieces = f"transform(a, (x, k) -> {sh.text(before, 'x')})"
    lf = "'\\n'"
    steps = (
        f"transform(ps, p -> struct(octet_length(p) - octet_length(replace(p, {lf}, '')) as nl, "
        f"octet_length(substring_index(p, {lf}, -1)) as tail))"
    )
    point = "struct(s.line + p.nl as line, if(p.nl = 0, s.col + p.tail, p.tail + 1) as col)"
    none = f"cast(array() as {_POINTS})"
    add = (
        "(s, p) -> struct(s.line + p.nl as line, "
        "if(p.nl = 0, s.col + p.tail, p.tail + 1) as col, "
        f"array_append(s.out, {point}) as out)"
    )
    start = f"struct(t.cur.line as line, t.cur.col as col, {none} as out)"
    some = (
        f"if(b * {_BLOCK} < size(st), transform(sequence(b * {_BLOCK}, "
        f"least((b + 1) * {_BLOCK}, size(st)) - 1), q -> get(st, q)), slice(st, 1, 0))"
    )
    block = (
        f"(t, b) -> struct(aggregate({some}, {start}, {add}) as cur, "
        "array_append(t.done, t.cur.out) as done)"
    )
    origin = (
        f"struct(struct(1 as line, 1 as col, {none} as out) as cur, "
        f"cast(array() as array<{_POINTS}>) as done)"
    )
    total = (
        f"aggregate(sequence(0, cast(size(st) div {_BLOCK} as int)), {origin}, {block}, "
        "t -> flatten(array_append(t.done, t.cur.out)))"
    )
    return named("a", "hits.at", named("ps", pieces, named("st", steps, total)))


def _placed(caps: Column, point: Column) -> Column:
    """Captures with 1-based line and byte column; the end is exclusive."""

    def place(c: Column) -> Column:
        line, col = _advance(point.line, point.col, c.lead)
        end_line, end_col = _advance(line, col, c.text)
        return F.struct(
            c["name"].alias("name"),
            c.text.alias("text"),
            line.alias("start_line"),
            col.alias("start_column"),
            end_line.alias("end_line"),
            end_col.alias("end_column"),
        )

    return F.transform(caps, place)


# --- conditions --------------------------------------------------------------------


def _may_hold(caps: str, wheres: Sequence[Sequence[Condition]], names: Sequence[str]) -> str:
    """SQL test that holds for every match some of the conditions accept.

    Conditions that all share, and one test per capture that all restrict, so the plan does
    not grow with the rules.  It only thins out the matches; the join with the rules decides.
    """
    shared = set.intersection(*map(set, wheres)) if wheres else set()
    tests = [_test(caps, c) for c in sorted(shared, key=repr)]
    for name in names:
        if any(c.capture == name for c in shared):
            continue
        listed = [[c for c in w if c.capture == name and _alone(c)] for w in wheres]
        if not all(listed):
            continue
        firsts = [x[0] for x in listed]
        whole = [re.escape(c.value) for c in firsts if c.op == "eq"]
        options = [rf"\A(?:{'|'.join(dict.fromkeys(whole))})\z"] if whole else []
        options += [f"(?:{c.value})" for c in firsts if c.op == "match"]
        tests.append(_test(caps, Condition(name, "match", _alternatives(options))))
    return sh.all_of(*tests) if tests else "true"


def _test(caps: str, c: Condition) -> str:
    """SQL test of one condition; it holds when the capture is absent."""
    value = f"get(filter({caps}, c -> c.name = {sh.quoted(c.capture)}), 0).text"
    test = f"{value} {'=' if c.op == 'eq' else 'rlike'} {sh.quoted(c.value)}"
    return f"coalesce({'not ' if c.op == 'not_match' else ''}({test}), true)"


def _alone(c: Condition) -> bool:
    """The test can stand in an alternation: it refers to no group."""
    return c.op == "eq" or (c.op == "match" and not re.search(r"\\[\dkQ]|\(\?[<x]|#", c.value))


# --- facts -------------------------------------------------------------------------

Wanted = dict[tuple[str, str], list[tuple[Condition, ...]]]


def _wanted(rules: Sequence[Rule]) -> Wanted:
    wanted: Wanted = {}
    for r in rules:
        wanted.setdefault((r.language.lower(), r.shape), []).append(tuple(r.where))
    return wanted


def every_shape(languages: Sequence[str] = schemas.LANGUAGES) -> Wanted:
    return {
        (lang, s.name): [()]
        for lang in languages
        for s in sh.REGISTRY.values()
        if lang in s.languages
    }


def _alternatives(regexes: Sequence[str]) -> str:
    return "(?:" + "|".join(dict.fromkeys(regexes)) + ")"


def _probe(language: str, wanted: Wanted) -> str | None:
    """Regex that every text with a wanted match contains; None when there is none."""
    probes = []
    for (lang, name), wheres in wanted.items():
        if lang == language:
            probes += [sh.REGISTRY[name].probe(w) for w in wheres]
    if any(p is None for p in probes):
        return None
    return _alternatives([f"(?:{p})" for p in probes])


@dataclass(frozen=True)
class _Plan:
    """What a language's files are searched for, as SQL in the order of evaluation."""

    anchors: str | None  # regex that some token of any shape begins with
    pools: dict[str, str]  # by column: the tokens a shape may stand at
    users: dict[str, list[str]]  # by bracket table: the pools whose matches look into it
    hits: str  # sorted ARRAY<STRUCT<at, anchor, k, shape, caps>>


def _plan(language: str, wanted: Wanted, needs: frozenset[str]) -> _Plan:
    parts, anchors, pools, users = [], [], {}, {}
    for (lang, name), wheres in wanted.items():
        if lang != language:
            continue
        shape = sh.REGISTRY[name]
        anchor = _alternatives([shape.anchor(w, language) for w in wheres])
        test, found = shape.found(language, needs)
        holds = _may_hold("m.caps", wheres, sh.captures_of(shape, language))
        if holds != "true":
            found = f"filter({found}, m -> {holds})"
        pool = "attrs"
        if name not in sh.ATTRIBUTE_SHAPES:
            pool = "pool"
            anchors.append(anchor)
        # the anchor is tried before any neighbour is looked at
        own = f"{language}{len(parts)}"
        pools[own] = f"filter({pool}, i -> {sh.begins('i', anchor)} and {test})"
        for table in sh.tables_in(found):
            users.setdefault(table, []).append(own)
        parts.append(
            f"flatten(transform({own}, "
            f"i -> transform({found}, (m, k) -> struct(m.at as at, i as anchor, k as k, "
            f"{sh.quoted(name)} as shape, m.caps as caps))))"
        )
    some = _alternatives(anchors) if anchors else None
    return _Plan(some, pools, users, f"array_sort(concat({', '.join(parts)}))")


def _searched(read: DataFrame, plans: dict[str, _Plan]) -> DataFrame:
    """``read`` (language, tok, attrs) with the pools, bracket tables and ``hits``.

    Matches walk through a file where that is a bounded number of steps in all; for more of
    them its brackets are paired once.
    """
    language = F.col("language")
    # one look at every token for all shapes; few tokens are left for each of them
    some = {
        lang: F.expr(f"filter({sh.every_token()}, i -> {sh.begins('i', p.anchors)})")
        for lang, p in plans.items()
        if p.anchors
    }
    if some:
        read = read.withColumn("pool", _case(language, some))
    read = read.withColumns(
        {k: F.when(language == lang, F.expr(v)) for lang, p in plans.items() for k, v in p.pools.items()}
    )
    tables: dict[str, dict[str, Column]] = {}
    for lang, p in plans.items():
        for table, pools in p.users.items():
            many = f"bigint({' + '.join(f'size({x})' for x in pools)}) * size(tok) > {sh.WALKED}"
            made = F.when(F.expr(many), F.expr(sh.table(table)))
            tables.setdefault(table, {})[lang] = made
    read = read.withColumns({name: _case(language, made) for name, made in tables.items()})
    hits = _case(language, {lang: F.expr(p.hits) for lang, p in plans.items()})
    # a second use of each table keeps Spark from moving it into the search for each match
    for name in tables:
        hits = F.when(F.coalesce(F.size(name), F.lit(0)) >= -1, hits)
    return read.withColumn("hits", hits)


def _case(language: Column, branches: dict[str, Column]) -> Column:
    out = None
    for lang, value in branches.items():
        test = language == F.lit(lang)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def facts_of(
    corpus: DataFrame,
    wanted: Wanted,
    keep: Sequence[str] = (),
    needs: frozenset[str] | None = None,
) -> DataFrame:
    """Matches of the wanted shapes, one row each (``schemas.FACTS`` and ``keep``).

    ``needs`` names the captures asked for (default all); costly ones are left out.
    """
    if needs is None:
        needs = frozenset(c for s in sh.REGISTRY.values() for c in s.captures)
    languages = [x for x in schemas.LANGUAGES if any(lang == x for lang, _ in wanted)]
    if not languages:
        # a schema that does not depend on the rules
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.struct_of(schemas.FACTS)]
        return corpus.where(F.lit(False)).select("path", *keep, *none[1:])
    language = F.lower("language")
    may = []
    for lang in languages:
        probe = _probe(lang, wanted)
        test = language == F.lit(lang)
        may.append(test & F.col("src").rlike(probe) if probe else test)
    columns = ["path", *keep]
    texts = corpus.where(functools.reduce(operator.or_, may)).select(
        *columns, language.alias("language"), "src"
    )
    src, lang_col = F.col("src"), F.col("language")
    code = {x: tk.code_tokens(src, x) for x in languages if x != "html"}
    markup = {"html": tk.html_tokens(src)} if "html" in languages else {}
    first = [_case(lang_col, code).alias("code")] if code else []
    if markup:
        first.append(_case(lang_col, markup).alias("markup"))
    read = texts.select(*columns, "language", *first)
    tok = F.col("code") if code else None
    attrs = F.array().cast("array<int>")
    if markup:
        html_tok = F.col("markup")["t"]
        tok = F.coalesce(tok, html_tok) if tok is not None else html_tok
        flags = F.col("markup")["attr"]
        at_attr = F.transform(flags, lambda f, k: F.when(f, k + sh.HEAD))
        attrs = F.array_compact(at_attr)
    pad = [F.array_repeat(F.lit(""), n) for n in (sh.HEAD, sh.TAIL)]
    read = read.select(
        *columns, "language", F.concat(pad[0], tok, pad[1]).alias("tok"), attrs.alias("attrs")
    )
    searched = _searched(read, {x: _plan(x, wanted, needs) for x in languages})
    matched = searched.select(*columns, "language", "tok", "hits")
    placed = matched.select(*columns, "language", "hits", F.expr(_points()).alias("points"))
    # the outer form keeps Spark from testing size(hits) first, which would find all
    # matches twice
    rows = placed.select(
        *columns,
        "language",
        F.posexplode_outer(F.arrays_zip("hits", "points")).alias("fact_no", "z"),
    ).where(F.col("z").isNotNull())
    return rows.select(
        *columns,
        "language",
        F.col("z.hits.shape").alias("shape"),
        "fact_no",
        _placed(F.col("z.hits.caps"), F.col("z.points")).alias("caps"),
    )


def facts(corpus: DataFrame, languages: Sequence[str] = schemas.LANGUAGES) -> DataFrame:
    """All matches of all shapes of the given languages."""
    return facts_of(corpus, every_shape(languages))


# --- pattern search ----------------------------------------------------------------


def pattern(shape: str, *where: tuple[str, str, str]) -> tuple[str, tuple[Condition, ...]]:
    """A pattern: a shape and conditions ``(capture, op, value)``."""
    if shape not in sh.REGISTRY:
        raise ValueError(f"unknown shape: {shape}")
    return shape, tuple(Condition(*w) for w in where)


def run_pattern(corpus: DataFrame, spec: tuple[str, tuple[Condition, ...]]) -> DataFrame:
    """All matches of one pattern in the files whose language has the shape."""
    shape, where = spec
    wanted = {(lang, shape): [where] for lang in sh.REGISTRY[shape].languages}
    return facts_of(corpus, wanted)


def run_pattern_once(corpus: DataFrame, spec: tuple[str, tuple[Condition, ...]]) -> DataFrame:
    """First match per file; a file's matches are pre-aggregated where they are found."""
    found = run_pattern(corpus, spec)
    first = F.min_by(F.struct("language", "shape", "fact_no", "caps"), "fact_no")
    return found.groupBy("path").agg(first.alias("f")).select("path", "f.*")


def captures(
    corpus: DataFrame, spec: tuple[str, tuple[Condition, ...]], name: str
) -> DataFrame:
    """Nodes of one capture name over all matches."""
    found = run_pattern(corpus, spec)
    picked = F.filter("caps", lambda c: c["name"] == F.lit(name))
    return found.select(
        "path", "language", "fact_no", F.posexplode(picked).alias("cap_no", "c")
    ).select("path", "language", "fact_no", "cap_no", "c.*")


# --- issues ------------------------------------------------------------------------


_RULE = ("rule_no", "rule_id", "rule_name", "severity", "message")


def _to_issues(matched: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Rows (path, fact_no, caps, rule columns, report) to one issue per reported capture."""
    reported = F.filter("caps", lambda c: F.array_contains("report", c["name"]))
    rows = matched.select(
        *keep, "path", "fact_no", *_RULE, F.posexplode(reported).alias("cap_no", "c")
    )
    return rows.select(
        *keep,
        "rule_id",
        "rule_name",
        "severity",
        "message",
        F.col("path").alias("file_path"),
        F.col("c.start_line").alias("start_line"),
        F.col("c.start_column").alias("start_column"),
        F.col("c.end_line").alias("end_line"),
        F.col("c.end_column").alias("end_column"),
        F.col("c.text").alias("code_snippet"),
        "rule_no",
        "fact_no",
        "cap_no",
    )


_ON = ["language", "shape", "capture", "text"]
GRAM = 3  # characters of a regex's literal by which it is found
_BY_GRAM = "~"  # before the capture's name


def _key() -> Column:
    return F.sha2(F.to_json(F.struct("language", "shape", "where", "report")), 256)


def _with_keys(rules: DataFrame) -> DataFrame:
    """Usable rules in one form; ``key`` is the same for rules that look for the same."""
    usable = with_problems(rules).where(F.col("problem").isNull())
    return usable.select(
        "rule_no",
        F.col("id").alias("rule_id"),
        F.col("name").alias("rule_name"),
        "severity",
        "message",
        F.lower("language").alias("language"),
        "shape",
        F.coalesce("where", F.array().cast(schemas.WHERE)).alias("where"),
        F.coalesce("report", F.array().cast("array<string>")).alias("report"),
    ).withColumn("key", _key())


def _texts(w: Column) -> Column:
    """The only texts a condition's capture may have; null when it is not that strict."""
    listed = F.regexp_extract(w["value"], r"^\^\(([\w$]+(?:\|[\w$]+)*)\)\$$", 1)
    return F.when(w["op"] == "eq", F.array(w["value"])).when(
        (w["op"] == "match") & (listed != ""), F.array_distinct(F.split(listed, r"\|"))
    )


def _required(regex: Column) -> Column:
    """The longest text that every match of a regex contains; null if none is easily seen.

    Groups, classes, escapes of letters and atoms that may be absent end a piece of plain
    text; alternatives, flags, look-around and quoting are left alone.
    """
    odd = r"\||\(\?|\\[QExupPkcN0]|\[[^\]]*\[|&&"
    x = regex
    for k, mark in enumerate(_MARKS):
        x = F.regexp_replace(x, re.escape("\\" + mark), chr(0xE000 + k))
    x = F.regexp_replace(x, r"\\[A-Za-z0-9]", "\u0001")
    x = F.regexp_replace(x, r"\[[^\]]*\]", "\u0001")
    for _ in range(4):
        x = F.regexp_replace(x, r"\([^()]*\)", "\u0001")
    nested = x.rlike(r"[()\[\]]")
    x = F.regexp_replace(x, r"(?s).(?:[*?]|\{[\d,]*\})[?+]?", "\u0001")
    x = F.regexp_replace(x, r"\+[?+]?|[.^$]", "\u0001")
    for k, mark in enumerate(_MARKS):
        x = F.replace(x, F.lit(chr(0xE000 + k)), F.lit(mark))
    pieces = F.filter(F.split(x, "\u0001"), lambda p: F.length(p) >= GRAM)
    longest = F.get(F.array_sort(F.transform(pieces, lambda p: F.struct(-F.length(p), p.alias("p")))), F.lit(0))
    private = regex.rlike("[\u0001\ue000-\ue0ff]")
    return F.when(~(regex.rlike(odd) | nested | private), longest["p"])


#: Characters that stand for themselves after a backslash.
_MARKS = r"\.*+?()[]{}|^$/-"


def _grams(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))


def _pieces(w: Column) -> Column:
    """The pieces by which a regex condition may be found; null when it has none."""
    grams = F.array_distinct(_grams(_required(w["value"])))
    return F.when(w["op"] == "match", F.nullif(grams, F.slice(grams, 1, 0)))


def _rarest(searches: DataFrame) -> DataFrame:
    """``searches`` with ``gram``, of the search's pieces the one that fewest searches have."""
    pieces = searches.select("key", F.explode("by.pieces").alias("gram"))
    counts = pieces.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    best = pieces.join(counts, "gram").groupBy("key").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    return searches.join(best, "key", "left")


def _searches(rules: DataFrame, by_literal: bool = True) -> DataFrame:
    """What rules look for, once each, with the capture and text to find it by.

    A search that fixes the texts of a capture all matches have is found by each of them.  A
    regex on such a capture is found by three characters of a text that it requires, those
    that fewest searches have, with the capture's name marked.  Any other search has an empty
    name and meets all matches of its shape; ``rest`` are the conditions left to test.  Few
    rules do without literals, as a match comes with all pieces of its text for them.
    """
    always = [
        f"{name}/{c}" for name, s in sh.REGISTRY.items() for c in s.captures if c not in s.optional
    ]
    given = F.filter("where", lambda w: F.concat_ws("/", F.col("shape"), w["capture"]).isin(always))
    strict = F.filter(given, lambda w: _texts(w).isNotNull())
    searches = rules.select("language", "shape", "where", "report", "key").distinct()
    searches = searches.withColumn("first", F.get(strict, F.lit(0)))
    marked = gram = F.lit(None).cast("string")
    if by_literal:
        found = F.transform(
            given, lambda w: F.struct(w["capture"].alias("capture"), _pieces(w).alias("pieces"))
        )
        by = F.get(F.filter(found, lambda g: g["pieces"].isNotNull()), F.lit(0))
        searches = _rarest(searches.withColumn("by", F.when(F.col("first").isNull(), by)))
        gram = F.col("gram")
        marked = F.when(gram.isNotNull(), F.concat(F.lit(_BY_GRAM), F.col("by.capture")))
    first = F.col("first")
    texts = F.coalesce(_texts(first), F.array(F.coalesce(gram, F.lit(""))))
    return searches.select(
        "language",
        "shape",
        "report",
        "key",
        F.coalesce(first["capture"], marked, F.lit("")).alias("capture"),
        F.filter("where", lambda w: ~w.eqNullSafe(first)).alias("rest"),
        F.explode(texts).alias("text"),
    )


def _met_by(searches: DataFrame) -> Column:
    """``capture, text`` by which a match may be found, for the captures some search asks for.

    One row for each language, shape and capture asked for comes to the driver.
    """
    asked = searches.select("language", "shape", "capture").distinct().collect()
    place = ["/".join(r) for r in asked]
    shape = F.concat_ws("/", "language", "shape")

    def asks(name: Column) -> Column:
        return F.concat_ws("/", shape, name).isin(place)

    def named(c: Column) -> Column:
        return F.struct(c["name"].alias("capture"), c["text"].alias("text"))

    whole = F.transform(F.filter("caps", lambda c: asks(c["name"])), named)
    parts = [whole]
    if any(r["capture"].startswith(_BY_GRAM) for r in asked):
        marked = F.filter("caps", lambda c: asks(F.concat(F.lit(_BY_GRAM), c["name"])))

        def grams(c: Column) -> Column:
            name = F.concat(F.lit(_BY_GRAM), c["name"])
            return F.transform(
                F.array_distinct(_grams(c["text"])),
                lambda g: F.struct(name.alias("capture"), g.alias("text")),
            )

        parts.append(F.flatten(F.transform(marked, grams)))
    if any(not r["capture"] for r in asked):
        none = F.struct(F.lit("").alias("capture"), F.lit("").alias("text"))
        empty = F.slice(F.array(none), 1, 0)
        parts.append(F.when(asks(F.lit("")), F.array(none)).otherwise(empty))
    return F.array_distinct(F.concat(*parts))


def _local(df: DataFrame) -> DataFrame:
    """Rows that come from a rule set, which the driver has anyway, as a table of values."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _named(keyed: DataFrame, column: str) -> list[tuple[str, str, str]]:
    """(language, shape, capture) of the captures that a column of the rules names."""
    rows = keyed.select("language", "shape", F.explode(column).alias("capture")).distinct()
    return [tuple(r) for r in rows.collect()]


def _prepared(
    rules: RuleSet | DataFrame, spark: SparkSession
) -> tuple[DataFrame, DataFrame, Wanted, frozenset[str]]:
    """(usable rules with keys, searches, shapes to look for, captures needed).

    A rule set narrows the search by its own texts.  Of a rule table, which may be of any
    size, one row per known shape, language and capture comes to the driver; the rules that can
    run and their searches are worked out once and kept below the shared folder.
    """
    if isinstance(rules, DataFrame):
        folder = shared_folder(spark)
        keyed = stored(_with_keys(rules), f"{folder}/rules")
        searches = stored(_searches(keyed), f"{folder}/searches")
        used = keyed.select("language", "shape").distinct().collect()
        wanted = {(r["language"], r["shape"]): [()] for r in used}
        needs = frozenset(c for _, _, c in [*_named(keyed, "where.capture"), *_named(keyed, "report")])
        return keyed, searches, wanted, needs
    keyed = _local(_with_keys(rules.to_df(spark)))
    numbers = {r["rule_no"] for r in keyed.select("rule_no").collect()}
    usable = [r for r in rules if r.rule_no in numbers]
    needs = frozenset(c for r in usable for c in (*r.report, *(w.capture for w in r.where)))
    return keyed, _local(_searches(keyed, by_literal=False)), _wanted(usable), needs


def _holds(w: Column) -> Column:
    """A condition on a capture that the match lacks holds, as there is nothing to refuse."""
    text = F.get(F.filter("caps", lambda x: x["name"] == w["capture"]), F.lit(0))["text"]
    test = (
        F.when(w["op"] == "eq", text == w["value"])
        .when(w["op"] == "match", F.rlike(text, w["value"]))
        .otherwise(~F.rlike(text, w["value"]))
    )
    return F.coalesce(test, F.lit(True))


def _found(
    corpus: DataFrame, rules: RuleSet | DataFrame, keep: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(matches with the key of each search they answer, usable rules with their keys)."""
    keyed, searches, wanted, needs = _prepared(rules, corpus.sparkSession)
    found = facts_of(corpus, wanted, keep, needs)
    columns = [*keep, "path", "fact_no", "caps"]
    by = found.select(*columns, "language", "shape", F.explode(_met_by(searches)).alias("by"))
    by = by.select(*columns, "language", "shape", "by.capture", "by.text")
    hits = by.join(searches, _ON).where(F.forall("rest", _holds))
    return hits.select(*columns, "key", "report"), keyed


def scan_all(
    corpus: DataFrame, rules: RuleSet | DataFrame, keep: Sequence[str] = ()
) -> DataFrame:
    """Issues of all rules over the corpus (``schemas.ISSUES``), overlaps included.

    One plan for any number of rules: shapes are compiled into it, rules are data.  A match
    meets each different search once, however many rules share it.  ``keep`` names further
    corpus columns to carry along.  Rules that cannot run are left out; see
    :func:`with_problems`.
    """
    hits, keyed = _found(corpus, rules, keep)
    return _to_issues(hits.join(keyed.select("key", *_RULE), "key"), keep)


def _kinds(found: DataFrame, keyed: DataFrame) -> DataFrame:
    """``kind, language, shape, caps, path, n``: equal matches of a file counted as one.

    Matches are of one kind if they have the same captures and the same texts in those that
    some rule tests, so the rules can't tell them apart.
    """
    tested = ["/".join(t) for t in _named(keyed, "where.capture")]

    def seen(c: Column) -> Column:
        place = F.concat_ws("/", F.col("language"), F.col("shape"), c["name"])
        return F.struct(c["name"].alias("name"), F.when(place.isin(tested), c["text"]).alias("text"))

    row = ["language", "shape", "caps"]
    rows = found.select("path", "language", "shape", F.transform("caps", seen).alias("caps"))
    rows = rows.groupBy("path", *row).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("kind", F.sha2(F.to_json(F.struct(*row)), 256))


def _answered(kinds: DataFrame, searches: DataFrame) -> DataFrame:
    """``key, kind, issues``: the kinds of match that each search accepts, with the issues that
    one such match gives."""
    rows = kinds.select("kind", "language", "shape", "caps").distinct()
    by = rows.select("*", F.explode(_met_by(searches)).alias("by"))
    met = by.select("*", "by.capture", "by.text").join(searches, _ON)
    n = F.size(F.filter("caps", lambda c: F.array_contains("report", c["name"])))
    hits = met.where(F.forall("rest", _holds)).groupBy("key", "kind").agg(F.sum(n).alias("issues"))
    return hits.where("issues > 0")


def rule_issue_counts(corpus: DataFrame, rules: RuleSet | DataFrame) -> DataFrame:
    """Issues and files per rule with any (``rule_no, rule_id, severity, issues, files``).

    Rules meet kinds of matches, see :func:`_kinds`, and searches that accept the same kinds are
    counted once, so neither rules that look for the same nor different rules that find the same
    multiply the matches.
    """
    spark = corpus.sparkSession
    keyed, searches, wanted, needs = _prepared(rules, spark)
    folder = shared_folder(spark)
    kinds = stored(_kinds(facts_of(corpus, wanted, (), needs), keyed), f"{folder}/kinds")
    hits = stored(_answered(kinds, searches), f"{folder}/hits")
    # a set of (kind, issues) as 128 bits and its size
    marks = ["a", "b", "kinds"]
    sets = hits.groupBy("key").agg(
        F.bit_xor(F.xxhash64("kind", "issues")).alias("a"),
        F.bit_xor(F.xxhash64("issues", F.lit("b"), "kind")).alias("b"),
        F.count(F.lit(1)).alias("kinds"),
    )
    firsts = sets.groupBy(*marks).agg(F.min("key").alias("first"))
    ones = hits.join(firsts.select(F.col("first").alias("key")), "key", "left_semi")
    issues = F.sum(F.col("issues") * F.col("n")).alias("n")
    per_file = ones.join(kinds.select("kind", "path", "n"), "kind").groupBy("key", "path").agg(issues)
    counts = per_file.groupBy(F.col("key").alias("first")).agg(
        F.sum("n").alias("issues"), F.count(F.lit(1)).alias("files")
    )
    of_key = sets.join(firsts, marks).select("key", "first").join(counts, "first")
    return of_key.join(keyed, "key").select("rule_no", "rule_id", "severity", "issues", "files")


def scan_rule(corpus: DataFrame, rule: Rule) -> DataFrame:
    """Issues of one rule."""
    return scan_all(corpus, RuleSet([rule]))


# --- rules that cannot run ---------------------------------------------------------


def with_problems(rules: DataFrame) -> DataFrame:
    """The rule table with ``problem``: why a rule cannot run, null when it can.

    Regexes are compiled by Java, which will run them.
    """
    known = {
        f"{lang}/{name}": sh.captures_of(sh.REGISTRY[name], lang) for lang, name in every_shape()
    }
    entries = [x for k, v in known.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    pair = F.concat_ws("/", F.lower("language"), "shape")
    names = F.try_element_at(F.create_map(*entries), pair)

    def first(items: Column) -> Column:
        return F.get(items, F.lit(0))

    def refused(regex: Column) -> Column:
        compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), regex)
        return compiled.isNull()

    ops = F.filter(
        "where", lambda w: ~F.coalesce(w["op"].isin("eq", "match", "not_match"), F.lit(False))
    )
    empty = F.filter("where", lambda w: w["capture"].isNull() | w["value"].isNull())
    tested = F.transform("where", lambda w: w["capture"])
    used = F.concat(
        F.coalesce(tested, F.array().cast("array<string>")),
        F.coalesce("report", F.array().cast("array<string>")),
    )
    patterns = F.filter("where", lambda w: (w["op"] != "eq") & refused(w["value"]))
    problem = (
        F.when(
            ~F.coalesce(F.col("shape").isin(list(sh.REGISTRY)), F.lit(False)),
            F.concat_ws(" ", F.lit("unknown shape"), "shape"),
        )
        .when(
            names.isNull(),
            F.concat_ws(" ", F.lit("shape"), "shape", F.lit("does not exist in"), "language"),
        )
        .when(F.size(ops) > 0, F.concat_ws(" ", F.lit("unknown test"), first(ops)["op"]))
        .when(F.size(empty) > 0, F.lit("a test without capture or value"))
        .when(
            F.size(F.array_except(used, names)) > 0,
            F.concat_ws(" ", F.lit("unknown capture"), first(F.array_except(used, names))),
        )
        .when(F.size(patterns) > 0, F.concat_ws(" ", F.lit("bad pattern"), first(patterns)["value"]))
    )
    return rules.withColumn("problem", problem)


def _refused(rules: RuleSet, spark: SparkSession) -> list[tuple[int, str, str]]:
    problems = with_problems(rules.to_df(spark)).where(F.col("problem").isNotNull())
    rows = problems.select("rule_no", "id", "problem").orderBy("rule_no").collect()
    return [tuple(r) for r in rows]


def rule_errors(rules: RuleSet) -> list[tuple[str, str]]:
    """(rule id, reason) of the rules that :func:`scan_all` leaves out."""
    spark = SparkSession.getActiveSession()
    return [(rule_id, why) for _, rule_id, why in _refused(rules, spark)]
