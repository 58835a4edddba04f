"""The bundled rules."""

from __future__ import annotations

from lintlake.operators.shapes import Condition
from lintlake.sources.rules import Rule, RuleSet

_MARKS = "(TODO|FIXME|HACK|XXX)"

# --- fixed values: the bundled rules (id, name, severity, message; language, shape,
# --- tests on captures, captures reported) ------------------------------------------
_RULES = [
    (
        "html-no-inline-event-handler",
        "No inline event handlers",
        "warning",
        "Inline event handlers (onclick, onload, etc.) mix behaviour with markup and enable XSS. Use addEventListener",
        ("html", "html_attr", [("attr", "match", "^on[a-z]+")], ["attr"]),
    ),
    (
        "html-no-inline-style",
        "No inline styles",
        "note",
        "Inline styles make theming and responsive design harder. Move styles to a CSS class",
        ("html", "html_attr", [("attr", "eq", "style")], ["attr"]),
    ),
    (
        "html-no-autofocus",
        "No autofocus attribute",
        "note",
        "autofocus can disorient screen reader users. Confirm this is intentional",
        ("html", "html_attr", [("attr", "eq", "autofocus")], ["attr"]),
    ),
    (
        "html-no-target-blank-unsafe",
        'No target="_blank" without rel',
        "warning",
        'target="_blank" without rel="noopener noreferrer" leaks window.opener. Add the rel attribute',
        (
            "html",
            "html_attr_quoted",
            [("attr", "eq", "target"), ("val", "eq", "_blank")],
            ["attr", "val"],
        ),
    ),
    (
        "js-no-console-log",
        "No console.log",
        "warning",
        "Remove console.log before committing. Use a structured logger instead",
        (
            "javascript",
            "member_call",
            [("obj", "eq", "console"), ("prop", "eq", "log")],
            ["obj", "prop"],
        ),
    ),
    (
        "js-no-console-any",
        "No console.*",
        "note",
        "Avoid console.* in production code. Use a structured logger",
        ("javascript", "member_call", [("obj", "eq", "console")], ["obj"]),
    ),
    (
        "js-no-debugger",
        "No debugger statement",
        "error",
        "debugger statement must not reach production",
        ("javascript", "stmt_keyword", [("keyword", "eq", "debugger")], ["statement"]),
    ),
    (
        "js-no-todo-comment",
        "No unresolved TODO/FIXME",
        "note",
        "Unresolved TODO/FIXME comment — create a ticket and remove the comment",
        ("javascript", "comment", [("comment", "match", _MARKS)], ["comment"]),
    ),
    (
        "js-no-magic-number",
        "No magic numbers",
        "note",
        "Extract magic numbers into named constants for readability",
        ("javascript", "declarator_number", [("num", "not_match", "^(0|1|-1)$")], ["num"]),
    ),
    (
        "js-no-eval",
        "No eval()",
        "error",
        "eval() executes arbitrary strings as code and is a critical security risk",
        ("javascript", "call", [("fn", "eq", "eval")], ["fn"]),
    ),
    (
        "js-no-document-write",
        "No document.write()",
        "error",
        "document.write() can overwrite the page and enables XSS attacks",
        (
            "javascript",
            "member_call",
            [("obj", "eq", "document"), ("prop", "eq", "write")],
            ["obj", "prop"],
        ),
    ),
    (
        "js-no-inner-html",
        "No innerHTML assignment",
        "error",
        "Direct innerHTML assignment enables XSS. Use textContent or a sanitizer",
        ("javascript", "member_assign", [("prop", "eq", "innerHTML")], ["prop"]),
    ),
    (
        "js-no-outer-html",
        "No outerHTML assignment",
        "error",
        "Direct outerHTML assignment enables XSS. Use textContent or a sanitizer",
        ("javascript", "member_assign", [("prop", "eq", "outerHTML")], ["prop"]),
    ),
    (
        "js-no-settimeout-string",
        "No setTimeout with string argument",
        "error",
        "Passing a string to setTimeout/setInterval is equivalent to eval()",
        (
            "javascript",
            "call_last_arg_string",
            [("fn", "match", "^(setTimeout|setInterval)$")],
            ["fn"],
        ),
    ),
    (
        "js-no-alert",
        "No alert/confirm/prompt",
        "warning",
        "Browser dialogs block the thread and should not reach production",
        ("javascript", "call", [("fn", "match", "^(alert|confirm|prompt)$")], ["fn"]),
    ),
    (
        "js-no-dangerously-set-inner-html",
        "No dangerouslySetInnerHTML",
        "error",
        "dangerouslySetInnerHTML bypasses React's XSS protection. Use a sanitizer if HTML rendering is required",
        ("javascript", "jsx_attr", [("attr", "eq", "dangerouslySetInnerHTML")], ["attr"]),
    ),
    (
        "py-no-print",
        "No print() statements",
        "warning",
        "Remove print() before committing. Use the logging module instead",
        ("python", "call", [("fn", "eq", "print")], ["fn"]),
    ),
    (
        "py-no-bare-except",
        "No bare except clause",
        "warning",
        "Bare except catches SystemExit and KeyboardInterrupt. Catch specific exception types",
        ("python", "except_bare", [], ["bare_except"]),
    ),
    (
        "py-no-todo-comment",
        "No unresolved TODO/FIXME",
        "note",
        "Unresolved TODO/FIXME comment — create a ticket and remove the comment",
        ("python", "comment", [("comment", "match", _MARKS)], ["comment"]),
    ),
    (
        "py-no-global-statement",
        "No global statement",
        "warning",
        "global mutates module-level state and makes code hard to reason about",
        ("python", "stmt_keyword", [("keyword", "eq", "global")], ["statement"]),
    ),
    (
        "py-no-eval",
        "No eval()",
        "error",
        "eval() executes arbitrary strings as code and is a critical security risk",
        ("python", "call", [("fn", "eq", "eval")], ["fn"]),
    ),
    (
        "py-no-exec",
        "No exec()",
        "error",
        "exec() executes arbitrary code and is a critical security risk",
        ("python", "call", [("fn", "eq", "exec")], ["fn"]),
    ),
    (
        "py-no-pickle-loads",
        "No pickle.loads()",
        "error",
        "pickle.loads() on untrusted data enables arbitrary code execution. Use a safe format like JSON",
        (
            "python",
            "member_call",
            [("obj", "eq", "pickle"), ("method", "eq", "loads")],
            ["obj", "method"],
        ),
    ),
    (
        "py-no-shell-true",
        "No subprocess with shell=True",
        "error",
        "shell=True with user-controlled input enables command injection. Pass a list of arguments instead",
        ("python", "kwarg_true", [("kw", "eq", "shell")], ["kw"]),
    ),
    (
        "py-no-assert-in-production",
        "No assert statements outside tests",
        "warning",
        "assert statements are stripped with -O. Use explicit conditionals for runtime validation",
        ("python", "stmt_keyword", [("keyword", "eq", "assert")], ["statement"]),
    ),
    (
        "py-no-hardcoded-password",
        "No hardcoded password variable",
        "error",
        "Hardcoded credential detected. Use environment variables or a secrets manager",
        (
            "python",
            "assign_string",
            [("name", "match", "(?i)(password|passwd|secret|api_key|token)")],
            ["name"],
        ),
    ),
    (
        "team-no-raw-fetch",
        "Use internal HTTP client instead of fetch()",
        "error",
        "Use apiClient() from @company/http — not fetch() directly. It handles auth, retries, and error formatting",
        ("javascript", "call", [("fn", "eq", "fetch")], ["fn"]),
    ),
    (
        "team-no-axios-import",
        "Do not import axios directly",
        "error",
        "Import httpClient from @company/http instead of importing axios directly",
        ("javascript", "import_source", [("src", "eq", "axios")], ["src"]),
    ),
    (
        "team-no-process-env",
        "Use config module instead of process.env",
        "warning",
        "Access config via getConfig() from @company/config — not process.env directly. Values are validated at startup",
        (
            "javascript",
            "member_chain",
            [("obj", "eq", "process"), ("prop", "eq", "env")],
            ["obj", "prop"],
        ),
    ),
    (
        "team-no-console-log",
        "Use internal logger instead of console.log",
        "error",
        "Use logger from @company/logger — not console.log. Structured logs are required in production",
        (
            "javascript",
            "member_call",
            [("obj", "eq", "console"), ("prop", "eq", "log")],
            ["obj", "prop"],
        ),
    ),
    (
        "team-no-raw-sql",
        "No raw SQL string literals",
        "warning",
        "Use the query builder or ORM instead of raw SQL strings — prevents injection and keeps queries auditable",
        (
            "javascript",
            "call_template_arg",
            [("sql", "match", r"(?i)(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE)\s")],
            ["sql"],
        ),
    ),
    (
        "team-no-empty-catch",
        "No empty catch blocks",
        "error",
        "Empty catch block silently swallows errors. At minimum, log the error before continuing",
        ("javascript", "catch_empty", [], ["empty_body"]),
    ),
    (
        "ts-no-any-annotation",
        "No 'any' type annotation",
        "warning",
        "Avoid 'any' — use 'unknown' and narrow the type, or define a proper interface",
        ("typescript", "type_annotation", [("type", "eq", "any")], ["type"]),
    ),
    (
        "ts-no-as-any",
        "No 'as any' type assertion",
        "error",
        "'as any' disables type checking entirely. Use a specific type assertion",
        ("typescript", "as_type", [("type", "eq", "any")], ["type"]),
    ),
    (
        "ts-no-ts-ignore",
        "No @ts-ignore",
        "warning",
        "@ts-ignore suppresses errors silently. Fix the underlying type issue or use @ts-expect-error with a comment",
        ("typescript", "comment", [("comment", "match", "@ts-ignore")], ["comment"]),
    ),
    (
        "ts-no-ts-nocheck",
        "No @ts-nocheck",
        "error",
        "@ts-nocheck disables type checking for the entire file",
        ("typescript", "comment", [("comment", "match", "@ts-nocheck")], ["comment"]),
    ),
    (
        "ts-no-non-null-assertion",
        "No non-null assertion operator",
        "warning",
        "Non-null assertion (!) hides potential null/undefined errors. Add an explicit null check instead",
        ("typescript", "non_null", [], ["expr"]),
    ),
]
# --- end of fixed values ---


def bundled_rules() -> RuleSet:
    return RuleSet(
        Rule(
            id=rule_id,
            name=name,
            severity=severity,
            language=language,
            message=message,
            shape=shape,
            where=tuple(Condition(*w) for w in where),
            report=tuple(report),
        )
        for rule_id, name, severity, message, (language, shape, where, report) in _RULES
    )


def documented_settimeout() -> Rule:
    """The wider reading of the timer rule: the *first* argument is a string."""
    base = bundled_rules().get("js-no-settimeout-string")
    return Rule(
        **{**base.__dict__, "id": "js-settimeout-first-string", "shape": "call_first_arg_string"}
    )
