"""Shapes and rules on small texts: one hit and near misses each, and exact positions."""

import ast
import dataclasses
import json
import sysconfig

import pytest
from pyspark.sql import functions as F

from lintlake import schemas
from lintlake.operators import scan as sc
from lintlake.operators.shapes import Condition
from lintlake.plans.catalog import bundled_rules, documented_settimeout
from lintlake.sources.rules import Rule, RuleSet, parse_rules
from tests.python_ast import python_ast_facts

LANG = {"js": "javascript", "ts": "typescript", "py": "python", "html": "html"}


def corpus(spark, **files):
    rows = [
        (f"{name}.{name.split('_')[0]}", LANG[name.split("_")[0]], text, str(hash(text)))
        for name, text in files.items()
    ]
    return spark.createDataFrame(rows, schemas.CORPUS)


def found(spark, text, lang, rule_id, rules=None):
    """(line, column, end line, end column, text) of the issues of one rule."""
    rule = (rules or bundled_rules()).get(rule_id)
    issues = sc.scan_rule(corpus(spark, **{lang: text}), rule)
    rows = issues.orderBy("fact_no", "cap_no").collect()
    return [
        (r.start_line, r.start_column, r.end_line, r.end_column, r.code_snippet) for r in rows
    ]


def texts(*args, **kw):
    return [x[4] for x in found(*args, **kw)]


BAD = """// several issues below

console.log("one");

function risky() {
    eval("two");
    console.log("Another console.log");
}
"""


def test_positions_of_calls(spark):
    assert found(spark, BAD, "js", "js-no-console-log") == [
        (3, 1, 3, 8, "console"),
        (3, 9, 3, 12, "log"),
        (7, 5, 7, 12, "console"),
        (7, 13, 7, 16, "log"),
    ]
    assert found(spark, BAD, "js", "js-no-eval") == [(6, 5, 6, 9, "eval")]
    assert len(found(spark, BAD, "js", "team-no-console-log")) == 4
    assert len(found(spark, BAD, "js", "js-no-console-any")) == 2


def test_other_methods_and_words_in_comments(spark):
    text = "const sum = add(5, 10);\nconsole.info(sum); // not console.log\n"
    assert found(spark, text, "js", "js-no-console-any") == [(2, 1, 2, 8, "console")]
    assert found(spark, text, "js", "js-no-console-log") == []


def test_columns_are_bytes(spark):
    assert found(spark, 'x = "é€"; eval(1)', "js", "js-no-eval") == [(1, 14, 1, 18, "eval")]


@pytest.mark.parametrize(
    ("rule", "text", "expected"),
    [
        ("js-no-console-log", "a.console.log(1); new console.log(); console['log'](1)", []),
        ("js-no-console-log", "console\n  .log(1)", ["console", "log"]),
        ("js-no-console-log", "console?.log?.(1)", ["console", "log"]),
        ("js-no-eval", "new eval(); x.eval(1); function eval(a) {} // eval(1)", []),
        ("js-no-eval", "eval/* c */(1); eval?.(2)", ["eval", "eval"]),
        ("js-no-inner-html", "el.innerHTML += x; y = el.innerHTML; el.innerHTML == 1", []),
        ("js-no-inner-html", "a.b().innerHTML = x", ["innerHTML"]),
        ("js-no-outer-html", "el.outerHTML = x", ["outerHTML"]),
        ("js-no-settimeout-string", 'setTimeout(f); setTimeout("x", 10); g("x")', []),
        ("js-no-settimeout-string", 'setTimeout("x"); setInterval(f(1), "y",)', ["setTimeout", "setInterval"]),
        ("js-no-magic-number", "const n = -5; const m = 1; const q = 5 + 1; f(a = 3, b = 5)", []),
        ("js-no-magic-number", "let z = 0, k = 42\nvar x = 0x1F;", ["42", "0x1F"]),
        ("js-no-magic-number", "let z = 1\na = 2, b = 3", []),
        ("js-no-debugger", "a.debugger; x = {debugger: 1}", []),
        ("js-no-debugger", "debugger\nx()", ["debugger"]),
        ("js-no-todo-comment", 'x = "// TODO"; // todo', []),
        ("js-no-todo-comment", "/* a\n FIXME */", ["/* a\n FIXME */"]),
        ("js-no-alert", "a.alert(1); alerts(1)", []),
        ("js-no-document-write", "document.writeln(1)", []),
        ("js-no-dangerously-set-inner-html", "dangerouslySetInnerHTML = {a: 1}", []),
        ("js-no-dangerously-set-inner-html", "<p id='a' dangerouslySetInnerHTML={{a: 1}} />", ["dangerouslySetInnerHTML"]),
        ("team-no-axios-import", "import x from 'axios2'; export * from 'axios'; f('axios')", []),
        ("team-no-axios-import", "import 'axios'; import {\n a } from \"axios\"", ["axios", "axios"]),
        ("team-no-process-env", "process.env['A']; x.process.env.A; process.env", []),
        ("team-no-raw-sql", "q(`a`); new Q(`DROP x`); tag`SELECT x`; x = `SELECT x`", []),
        ("team-no-raw-sql", "a.q(1, `delete from x`)", ["`delete from x`"]),
        ("team-no-empty-catch", "try {} catch (e) { log(e) }; p.catch(() => {})", []),
        ("team-no-empty-catch", "try {} catch ({a, b}) { }", ["{ }"]),
        ("team-no-raw-fetch", "a.fetch(1); /fetch(1)/.test(x)", []),
    ],
)
def test_javascript(spark, rule, text, expected):
    assert texts(spark, text, "js", rule) == expected


@pytest.mark.parametrize(
    ("rule", "text", "expected"),
    [
        ("ts-no-any-annotation", "x = c ? y : any; let a: any[] = []; f(b as any)", []),
        ("ts-no-any-annotation", "function f(x: any, y?: any): any {}", ["any"] * 3),
        ("ts-no-any-annotation", "interface I { a: any; b: string }", ["any"]),
        ("ts-no-as-any", "x as any[]; import * as any from 'x'; import {a as any} from 'x'", []),
        ("ts-no-as-any", "f(x() as any)", ["any"]),
        ("ts-no-ts-ignore", "x = '@ts-ignore'", []),
        ("ts-no-ts-nocheck", "// @ts-nocheck", ["// @ts-nocheck"]),
        ("ts-no-non-null-assertion", "if (!x) {} a !== b; let q!: string; return !z", []),
        ("ts-no-non-null-assertion", "f(a.b(1)[0]!, c!)", ["a.b(1)[0]!", "c!"]),
        ("ts-no-non-null-assertion", "this.x!.y; new A()!.b", ["this.x!", "new A()!"]),
    ],
)
def test_typescript(spark, rule, text, expected):
    assert texts(spark, text, "ts", rule) == expected


@pytest.mark.parametrize(
    ("rule", "text", "expected"),
    [
        ("py-no-print", "a.print(1)\ndef print(x): pass\nx = print", []),
        ("py-no-eval", "ast.literal_eval(x); eval (x)", ["eval"]),
        ("py-no-exec", "'exec(1)'\n# exec(1)", []),
        ("py-no-pickle-loads", "a.pickle.loads(x); pickle.load(x)", []),
        ("py-no-shell-true", "def f(shell=True): pass\nrun(shell=False)\nrun(shell=True and x)", []),
        ("py-no-shell-true", "run([1], a=(2), shell=True,)", ["shell"]),
        ("py-no-bare-except", "try:\n  a\nexcept E:\n  b\nexcept:\n  c\n  # d\nelse:\n  e", ["except:\n  c"]),
        ("py-no-global-statement", "def f():\n  global a, b  # c\n", ["global a, b"]),
        ("py-no-assert-in-production", "assert (a,\n  b), 'c'; d()", ["assert (a,\n  b), 'c'"]),
        ("py-no-hardcoded-password", "f(\n  token='a')\ntoken = 'a' + b\ntokens = ('a')\na, token = 'b'", []),
        ("py-no-hardcoded-password", "if x: token = 'a'\nMY_SECRET: str = b'x'\nx = api_key = '''a\nb'''", ["token", "MY_SECRET", "api_key"]),
        ("py-no-hardcoded-password", "def token(): pass\ntry:\n  token\nelse:\n  x = 'a'", []),
        ("py-no-todo-comment", "x = '# TODO'  # XXX", ["# XXX"]),
    ],
)
def test_python(spark, rule, text, expected):
    assert texts(spark, text, "py", rule) == expected


@pytest.mark.parametrize(
    ("rule", "text", "expected"),
    [
        ("html-no-inline-event-handler", "<a onClick='x' data-onx=1>onclick=1</a>", []),
        ("html-no-inline-event-handler", "<a\n onload=x>", ["onload"]),
        ("html-no-inline-style", '<style>a{style="x"}</style><p title="style=1">', []),
        ("html-no-autofocus", "<input autofocus><input autofocus=''>", ["autofocus", "autofocus"]),
        ("html-no-target-blank-unsafe", "<a target=_blank><a target='_self'>", []),
        ("html-no-target-blank-unsafe", "<a target='_blank' rel=noopener>", ["target", "_blank"]),
    ],
)
def test_html(spark, rule, text, expected):
    assert texts(spark, text, "html", rule) == expected


def test_rules_of_another_language_stay_out(spark):
    issues = sc.scan_all(corpus(spark, ts="console.log(1); let a: any"), bundled_rules())
    assert {r.rule_id for r in issues.collect()} == {"ts-no-any-annotation"}


def test_documented_reading_of_the_timer_rule(spark):
    rules = RuleSet([documented_settimeout()])
    text = 'setTimeout("x", 10); setTimeout(f, "x")'
    assert texts(spark, text, "js", "js-settimeout-first-string", rules) == ["setTimeout"]


def test_assigned_secret_and_call_arguments(spark):
    code = corpus(spark, js='cfg.api_key = "abc"; cfg.token = x; f.g("a", h(1))')
    spec = sc.pattern("member_assign_string", ("prop", "match", "api.*key|secret|token"))
    caps = sc.run_pattern(code, spec).collect()[0].caps
    assert [(c.name, c.text) for c in caps] == [("prop", "api_key"), ("value", '"abc"')]
    call = sc.run_pattern(code, sc.pattern("member_call")).collect()[0].caps
    assert {c.name: c.text for c in call} == {
        "obj": "f",
        "prop": "g",
        "args": '("a", h(1))',
        "arg": '"a"',
    }
    with pytest.raises(ValueError):
        sc.pattern("no_such_shape")


def test_long_walks_find_what_short_ones_do(spark):
    many = ", ".join(f"f({n})" for n in range(300))
    assert texts(spark, f'setTimeout({many}, "x")', "js", "js-no-settimeout-string") == ["setTimeout"]
    assert texts(spark, f"run({many}, shell=True)", "py", "py-no-shell-true") == ["shell"]
    assert texts(spark, f"q({many}, `SELECT 1 `)", "js", "team-no-raw-sql") == ["`SELECT 1 `"]
    chain = ".m(1)" * 200
    assert texts(spark, f"a{chain}!", "ts", "ts-no-non-null-assertion") == [f"a{chain}!"]


def test_many_matches_in_one_line_and_file(spark):
    n = 1500
    one = "eval(1);" * n
    rows = found(spark, one, "js", "js-no-eval")
    assert [r[1] for r in rows] == [1 + 8 * k for k in range(n)]
    rows = found(spark, "eval(1);\n" * n, "js", "js-no-eval")
    assert [r[0] for r in rows] == list(range(1, n + 1))


def test_long_literals_do_not_overflow(spark):
    text = 'x = "' + "\\\\" * 200_000 + '"; eval(1) /* ' + "*" * 200_000 + "*/"
    assert texts(spark, text, "js", "js-no-eval") == ["eval"]


def test_same_result_with_any_partitioning(spark, sf):
    from lintlake.plans import views as V

    code = V.code_corpus(spark, sf, "javascript")
    one = sc.scan_all(code.coalesce(1), bundled_rules()).collect()
    eight = sc.scan_all(code.repartition(8), bundled_rules()).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, eight))


def test_unusable_rules_are_named_and_skipped(spark):
    good = bundled_rules().get("js-no-eval")
    bad = [
        Rule("a", "a", "error", "javascript", "m", "no_shape"),
        Rule("b", "b", "error", "python", "m", "jsx_attr"),
        parse_rules(
            "rules: [{id: c, name: c, severity: note, language: javascript, message: m, "
            "query: {shape: call, where: [{capture: fn, op: match, value: '('}]}}]"
        ).get("c"),
    ]
    rules = RuleSet([*bad, good])
    assert [e[0] for e in sc.rule_errors(rules)] == ["a", "b", "c"]
    issues = sc.scan_all(corpus(spark, js="eval(1)"), rules).collect()
    assert [r.rule_id for r in issues] == ["js-no-eval"]


def _issues_of(rows):
    return sorted((r.rule_id, r.start_line, r.start_column, r.code_snippet) for r in rows)


def test_rule_table_gives_the_same_as_a_rule_set(spark):
    rules = RuleSet(r for r in bundled_rules() if r.language == "javascript")
    code = corpus(spark, js=BAD + "\nconst n = 5; // TODO\nalert(1); setTimeout('x')")
    one = sc.scan_all(code, rules).collect()
    assert _issues_of(one) == _issues_of(sc.scan_all(code, rules.to_df(spark)).collect()) and one


def test_any_number_of_rules_gives_the_same_rows(spark):
    code = corpus(spark, js=BAD + "\nalert(1); o.m('x'); o.m(); p.log(o.eval)")
    base = [r for r in bundled_rules() if r.language == "javascript"][:6]
    bad = [
        dataclasses.replace(base[0], id="op", where=(Condition("fn", "like", "x"),)),
        dataclasses.replace(base[0], id="regex", where=(Condition("fn", "match", "("),)),
        dataclasses.replace(base[0], id="shape", shape="no_shape"),
        Rule("capture", "c", "note", "javascript", "m", "member_call", (Condition("prp", "eq", "log"),), ("obj",)),
        Rule("report", "c", "note", "javascript", "m", "member_call", (), ("method",)),
    ]
    many = [
        Rule(f"n{k}", "n", "note", "javascript", "m", "call", (Condition("fn", "eq", f"f{k}"),), ("fn",))
        for k in range(1000)
    ]
    small, large = RuleSet([*base, *bad]), RuleSet([*base, *bad, *many])
    want = _issues_of(sc.scan_all(code, RuleSet(base)).collect())
    for rules in (small, large, small.to_df(spark), large.to_df(spark)):
        assert _issues_of(sc.scan_all(code, rules).collect()) == want and want
    assert {e[0] for e in sc.rule_errors(large)} == {"op", "regex", "shape", "capture", "report"}


def test_condition_on_an_absent_capture_holds_for_sets_and_tables(spark):
    rule = Rule("r", "r", "note", "javascript", "m", "member_call", (Condition("arg", "eq", "'x'"),), ("obj",))
    code = corpus(spark, js="o.m('x'); p.m(1); q.m('y')")
    for rules in (RuleSet([rule]), RuleSet([rule]).to_df(spark)):
        got = sc.scan_all(code, rules).collect()
        assert sorted(r.code_snippet for r in got) == ["o", "p"]


def test_no_usable_rule_keeps_the_columns(spark):
    code = corpus(spark, js="eval(1)")
    full = sc.scan_all(code, bundled_rules(), keep=["content_sha"])
    none = sc.scan_all(code, RuleSet([]), keep=["content_sha"])
    assert none.columns == full.columns and none.count() == 0


def test_probe_with_look_around_drops_no_file(spark):
    rule = Rule("t", "t", "note", "javascript", "m", "comment", (Condition("comment", "match", "TODO(?!.)"),), ("comment",))
    got = sc.scan_all(corpus(spark, js="/*TODO*/x // TODO"), RuleSet([rule])).collect()
    assert [r.code_snippet for r in got] == ["// TODO"]


def test_counts_per_rule(spark):
    two = [Rule(f"c{k}", "c", "note", "javascript", "m", "call", (Condition("fn", "eq", "f"),), ("fn",)) for k in (1, 2)]
    code = corpus(spark, js="f(1); f(2)", js_b="g(1)")
    rows = sc.rule_issue_counts(code, RuleSet(two)).collect()
    assert sorted((r.rule_id, r.issues, r.files) for r in rows) == [("c1", 2, 1), ("c2", 2, 1)]


def test_python_spans_equal_the_syntax_tree(spark):
    lib = sysconfig.get_paths()["stdlib"]
    names = ("socket", "typing", "subprocess", "threading", "inspect", "ast", "cgitb", "pdb")
    files = {}
    for n in names:
        try:
            with open(f"{lib}/{n}.py", encoding="utf-8") as f:
                files[f"py_{n}"] = f.read()
        except FileNotFoundError:
            continue
    code = corpus(spark, **files)
    wanted = {("python", "except_bare"): [()], ("python", "stmt_keyword"): [()]}
    cols = ("path", "shape", F.get("caps", F.lit(0)).alias("c"))
    plain = {repr(r) for r in sc.facts_of(code, wanted).select(*cols).collect()}
    exact = {repr(r) for r in python_ast_facts(code).select(*cols).collect()}
    assert plain == exact and plain


def test_ast_facts_of_a_text_that_does_not_parse(spark):
    code = corpus(spark, py="try:\n  a(\nexcept:\n  b\nglobal x\n")
    shapes = {r["shape"] for r in python_ast_facts(code).collect()}
    with pytest.raises(SyntaxError):
        ast.parse("try:\n  a(\n")
    assert shapes == {"except_bare", "stmt_keyword"}


def test_rules_file(spark, tmp_path):
    path = tmp_path / "rules.yaml"
    rule = {
        "id": "x",
        "name": "X",
        "severity": "error",
        "language": "JavaScript",
        "message": "m",
        "query": {"shape": "call", "where": [{"capture": "fn", "op": "eq", "value": "x"}]},
        "metadata": {"docs": "d"},
        "extra": 1,
    }
    path.write_text(json.dumps({"rules": [rule]}))
    from lintlake.sources.rules import load_rules

    rules = load_rules(spark, str(path))
    assert [r.id for r in rules.for_language("JAVASCRIPT")] == ["x"]
    assert json.loads(rules.get("x").metadata) == {"docs": "d"}
    for broken in ({"severity": "Error"}, {"message": None}, {"query": "(call)"}):
        text = json.dumps({"rules": [rule, {**rule, **broken}]})
        with pytest.raises(ValueError):
            parse_rules(text)
    with pytest.raises(ValueError):
        parse_rules(json.dumps({"rules": [{k: v for k, v in rule.items() if k != "name"}]}))
    assert [r.id for r in RuleSet([*rules]).only(" x ,y")] == ["x"]


def test_a_folder_of_rule_files_is_one_set(spark, tmp_path):
    from lintlake.sources.rules import load_rules

    for name in ("b", "a", "c"):
        (tmp_path / f"{name}.yaml").write_text(
            f"rules: [{{id: {name}, name: n, severity: error, language: javascript, message: m,"
            " query: {shape: member_call, where: [], report: [prop]}}]\n"
        )
    assert [r.id for r in load_rules(spark, str(tmp_path))] == ["a", "b", "c"]


def test_rule_files_as_a_table(spark, tmp_path):
    from lintlake.sources.rules import load_rules, read_rules

    one = "- {id: %s, name: n, severity: note, language: python, message: m, query: {shape: call, where: [{capture: fn, op: eq, value: x}]}, metadata: {a: [1]}}\n"
    for name, ids in (("b.yaml", "cd"), ("a.yaml", "ab"), ("c.yaml", "e")):
        (tmp_path / name).write_text("rules:\n" + "".join(one % x for x in ids))
    want = load_rules(spark, str(tmp_path)).to_df(spark)
    read = read_rules(spark, str(tmp_path))
    assert read.schema == want.schema
    assert sorted(read.collect()) == sorted(want.collect())
    assert [r.id for r in read.orderBy("rule_no").collect()] == list("abcde")
    (tmp_path / "d.yaml").write_text("rules:\n- {id: x}\n")
    with pytest.raises(Exception, match="missing field"):
        read_rules(spark, str(tmp_path))
