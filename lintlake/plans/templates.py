"""Lines the code corpora are written from, and the issues each is known to hold.

``{id}`` stands for the event id.  An issue is (rule, line, text before it on that line,
its own text); the expected positions follow from these texts alone, not from a scan.
"""

from __future__ import annotations

from dataclasses import dataclass

Hit = tuple[str, int, str, str]


@dataclass(frozen=True)
class Template:
    lines: tuple[str, ...]
    hits: tuple[Hit, ...] = ()


def _t(lines: str, *hits: Hit) -> Template:
    return Template(tuple(lines.split("\n")), hits)


def _log(line: int, before: str) -> tuple[Hit, ...]:
    return (
        ("js-no-console-log", line, before, "console"),
        ("js-no-console-log", line, before + "console.", "log"),
        ("js-no-console-any", line, before, "console"),
        ("team-no-console-log", line, before, "console"),
        ("team-no-console-log", line, before + "console.", "log"),
    )


_JAVASCRIPT = (
    _t("const v{id} = {id};", ("js-no-magic-number", 0, "const v{id} = ", "{id}")),
    _t(
        "let a{id} = 1, b{id} = {id}; const n = -5, q = {id} + 1; f(a = 1, b = 5);",
        ("js-no-magic-number", 0, "let a{id} = 1, b{id} = ", "{id}"),
    ),
    _t('const é{id} = "é"; console . log({id});', *(
        (r, n, b.replace("console.", "console . "), t)
        for r, n, b, t in _log(0, 'const é{id} = "é"; ')
    )),
    _t('  eval("{id}"); window.eval("{id}"); new eval();', ("js-no-eval", 0, "  ", "eval")),
    _t(
        "document.write({id}); document.writeln({id}); a.document.write({id});",
        ("js-no-document-write", 0, "", "document"),
        ("js-no-document-write", 0, "document.", "write"),
    ),
    _t("// TODO {id}", ("js-no-todo-comment", 0, "", "// TODO {id}")),
    _t("debugger;", ("js-no-debugger", 0, "", "debugger;")),
    _t(
        'el.innerHTML = "{id}"; el.innerHTML += "x"; el.outerHTML = "{id}"; x = el.innerHTML;',
        ("js-no-inner-html", 0, "el.", "innerHTML"),
        ("js-no-outer-html", 0, 'el.innerHTML = "{id}"; el.innerHTML += "x"; el.', "outerHTML"),
    ),
    _t(
        'setTimeout("{id}"); setTimeout("x", {id}); setInterval(f(1, 2), "{id}"); setTimeout(f);',
        ("js-no-settimeout-string", 0, "", "setTimeout"),
        ("js-no-settimeout-string", 0, 'setTimeout("{id}"); setTimeout("x", {id}); ', "setInterval"),
    ),
    _t(
        'alert({id}); confirm("a"); a.prompt({id}); function prompt(x) {}',
        ("js-no-alert", 0, "", "alert"),
        ("js-no-alert", 0, "alert({id}); ", "confirm"),
    ),
    _t(
        "const e{id} = <div dangerouslySetInnerHTML={{h: {id}}} />;",
        ("js-no-dangerously-set-inner-html", 0, "const e{id} = <div ", "dangerouslySetInnerHTML"),
    ),
    _t(
        'fetch("/{id}"); api.fetch("/{id}"); const r = /fetch("x")/;',
        ("team-no-raw-fetch", 0, "", "fetch"),
    ),
    _t(
        "import axios from 'axios'; import y from 'axios{id}'; export * from 'axios';",
        ("team-no-axios-import", 0, "import axios from '", "axios"),
    ),
    _t(
        'const h = process.env.HOME{id}; const g = process.env["X"];',
        ("team-no-process-env", 0, "const h = ", "process"),
        ("team-no-process-env", 0, "const h = process.", "env"),
    ),
    _t(
        "db.query(`SELECT ${x} FROM t{id}`); new Query(`DROP t{id}`); db.query(`x{id}`);",
        ("team-no-raw-sql", 0, "db.query(", "`SELECT ${x} FROM t{id}`"),
    ),
    _t(
        "try {\n  run({id});\n} catch (e) { /* {id} */ }\ntry { run(); } catch { stop({id}); }",
        ("team-no-empty-catch", 2, "} catch (e) ", "{ /* {id} */ }"),
    ),
    _t(
        '/* FIXME {id}\n   more */ console.warn("é", {id});',
        ("js-no-todo-comment", 0, "", "/* FIXME {id}\n   more */"),
        ("js-no-console-any", 1, "   more */ ", "console"),
    ),
    _t("const s{id} = \"console.log(1) // TODO\"; const t = 'eval(\"x\")'; // note {id}"),
)

_PYTHON = (
    _t("print({id}); obj.print({id})", ("py-no-print", 0, "", "print")),
    _t('x = eval("{id}"); y = obj.eval("{id}")', ("py-no-eval", 0, "x = ", "eval")),
    _t(
        'token_{id} = "{id}"\nf(\n  secret="{id}")',
        ("py-no-hardcoded-password", 0, "", "token_{id}"),
    ),
    _t('exec("{id}")', ("py-no-exec", 0, "", "exec")),
    _t(
        "pickle.loads(b{id}); dill.loads(x)",
        ("py-no-pickle-loads", 0, "", "pickle"),
        ("py-no-pickle-loads", 0, "pickle.", "loads"),
    ),
    _t(
        'subprocess.run("{id}", shell=True); run(shell=False)',
        ("py-no-shell-true", 0, 'subprocess.run("{id}", ', "shell"),
    ),
    _t(
        "try:\n    run({id})\nexcept:\n    é = {id}\n\n    z = 1  # end\ny = 1",
        ("py-no-bare-except", 2, "", "except:\n    é = {id}\n\n    z = 1"),
    ),
    _t("try:\n    run({id})\nexcept ValueError:\n    pass"),
    _t(
        "def f{id}():\n    global a, b{id}\n    a = {id}",
        ("py-no-global-statement", 1, "    ", "global a, b{id}"),
    ),
    _t(
        'assert (x{id} ==\n        {id}), "m"  # note',
        ("py-no-assert-in-production", 0, "", 'assert (x{id} ==\n        {id}), "m"'),
    ),
    _t("n = {id}  # TODO {id}", ("py-no-todo-comment", 0, "n = {id}  ", "# TODO {id}")),
    _t('s{id} = """print(1)\n# TODO eval(x)"""'),
    _t(
        'password: str = "é{id}"; name = "token"',
        ("py-no-hardcoded-password", 0, "", "password"),
    ),
    _t('api_key = get("{id}"); token = "a" + "b"'),
)

_TYPESCRIPT = (
    _t("let a{id}: any = {id};", ("ts-no-any-annotation", 0, "let a{id}: ", "any")),
    _t(
        "const b{id} = x as any; const c = y as any[];",
        ("ts-no-as-any", 0, "const b{id} = x as ", "any"),
    ),
    _t(
        "const d{id} = y!.z; const e = x !== y;",
        ("ts-no-non-null-assertion", 0, "const d{id} = ", "y!"),
    ),
    _t("// @ts-ignore {id}", ("ts-no-ts-ignore", 0, "", "// @ts-ignore {id}")),
    _t("/* @ts-nocheck {id} */", ("ts-no-ts-nocheck", 0, "", "/* @ts-nocheck {id} */")),
    _t(
        "function f{id}(p?: any, q: any[]): any { return c ? p : any; }",
        ("ts-no-any-annotation", 0, "function f{id}(p?: ", "any"),
        ("ts-no-any-annotation", 0, "function f{id}(p?: any, q: any[]): ", "any"),
    ),
    _t(
        'foo("é", {id})!.bar; if (!x) { y(); }',
        ("ts-no-non-null-assertion", 0, "", 'foo("é", {id})!'),
    ),
    _t("console.log({id}); // any: any"),
)

_HTML = (
    _t(
        '<a onclick="f({id})" onClick="g()">x</a>',
        ("html-no-inline-event-handler", 0, "<a ", "onclick"),
    ),
    _t('<p style="k:{id}">é style="x"</p>', ("html-no-inline-style", 0, "<p ", "style")),
    _t("<input autofocus name=n{id}>", ("html-no-autofocus", 0, "<input ", "autofocus")),
    _t(
        '<a target="_blank" href="/{id}">y</a><a target=_blank>z</a>',
        ("html-no-target-blank-unsafe", 0, "<a ", "target"),
        ("html-no-target-blank-unsafe", 0, '<a target="', "_blank"),
    ),
    _t("<script>if (a<b) style=\"{id}\"; t = \"<p style='x'>\";</script>"),
    _t('<!-- <p style="{id}"> -->'),
    _t("<p\n  é=\"1\" style='{id}'>q</p>", ("html-no-inline-style", 1, '  é="1" ', "style")),
)

TEMPLATES = {
    "javascript": _JAVASCRIPT,
    "python": _PYTHON,
    "typescript": _TYPESCRIPT,
    "html": _HTML,
}

# Ids the number rule leaves alone.
NOT_MAGIC = (0, 1)
