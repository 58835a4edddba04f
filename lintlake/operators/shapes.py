"""Shapes: the candidate matches a rule can ask for, as tests on a token array.

A shape looks at one anchor token ``i`` and its neighbours in the array column ``tok``
and gives matches.  A match is ``(at, caps)``: the token it starts at and its captures
``(name, lead, text)``, where ``lead`` is the text between the start of token ``at`` and
the capture; positions follow from it later.  Shapes are written as Spark SQL expressions
over ``tok``; new ones are added with :func:`register`.

``tok`` has ``HEAD`` empty entries before and ``TAIL`` after the tokens of the file, so a
neighbour always exists.

Tokens are not a grammar.  Known departures from an exact syntax tree:

* code inside ``${...}`` of a template string belongs to the template token;
* a class or object method named like a called function (``eval(x) {``) is a call;
* a quote in JSX text opens a string up to the next quote on that line;
* ``type_annotation``: an object value that is the bare identifier ``any`` counts
  when its braces may also be a type literal;
* ``declarator_number``: only plain identifiers as declared names;
* ``jsx_attr``: told from an assignment by the token before the name;
* ``import_source``: a module name with escapes is left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from lintlake.operators import tokens as tk

CODE = ("javascript", "typescript", "python")
SCRIPT = ("javascript", "typescript")
HEAD, TAIL = 4, 6
_LAST = f"(size(tok) - {TAIL + 1})"
_MATCHES = "array<struct<at:int,caps:array<struct<name:string,lead:string,text:string>>>>"
_NO_MATCH = f"cast(array() as {_MATCHES})"

# --- fixed values: words of the languages that never name a called function ---
_SCRIPT_NOT_CALLABLE = (
    "if for while switch catch return typeof function new class import super await yield "
    "void delete throw case in of do else with var let const this"
).split()
_PYTHON_NOT_CALLABLE = (
    "if elif else while for return yield assert not and or in is lambda def class import "
    "from except raise del global nonlocal with as pass try finally await"
).split()
_PREDEFINED_TYPES = "any number boolean string symbol unknown never void object".split()
_PYTHON_HEADS = (
    "if elif else while for try except finally with def class async match case".split()
)
# --- end of fixed values ---

_WORD_END = r"(?![\w$])"
_VALUE_END = r"[\w$\"'`)\]}]$"
_MEMBER = r"\.(?!\.)|\?\."


@dataclass(frozen=True)
class Condition:
    """One test of a rule on a capture: op is ``eq``, ``match`` or ``not_match``."""

    capture: str
    op: str
    value: str


Where = Sequence[Condition]


def literals(where: Where, capture: str) -> list[str] | None:
    """The only texts ``capture`` may have, when the conditions say so."""
    for c in where:
        if c.capture != capture:
            continue
        if c.op == "eq":
            return [c.value]
        m = re.fullmatch(r"\^\(([\w$]+(?:\|[\w$]+)*)\)\$", c.value)
        if c.op == "match" and m:
            return m.group(1).split("|")
    return None


# --- pieces of SQL -------------------------------------------------------------------


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def is_like(text: str, regex: str) -> str:
    return f"({text} rlike {quoted(regex)})"


def tok(i: str) -> str:
    return f"get(tok, {i})"


def begins(i: str, regex: str) -> str:
    """Token i begins with a match of the regex."""
    return is_like(tok(i), rf"\A(?:{regex})")


def _words(words: Iterable[str]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words) + ")" + _WORD_END


def word(i: str, *words: str) -> str:
    return begins(i, _words(words))


def text(i: str, j: str) -> str:
    """Text of tokens i .. j-1; ``slice`` would copy all tokens of the file first."""
    return f"if({j} > {i}, array_join(transform(sequence({i}, {j} - 1), q -> get(tok, q)), ''), '')"


def core(i: str, lang: str) -> str:
    return f"regexp_extract({tok(i)}, {quoted(rf'\A(?:{tk.CORE[lang]})')}, 0)"


def span(i: str, j: str, lang: str) -> str:
    """Text from token i to the core of token j."""
    return f"concat({text(i, j)}, {core(j, lang)})"


def name(i: str, lang: str) -> str:
    return f"regexp_extract({tok(i)}, {quoted(rf'\A{tk.IDENT[lang]}')}, 0)"


def is_name(i: str, lang: str) -> str:
    return begins(i, tk.IDENT[lang])


def cap(capture: str, lead: str, value: str) -> str:
    return f"struct({quoted(capture)} as name, {lead} as lead, {value} as text)"


def all_of(*tests: str) -> str:
    return "(" + " and ".join(tests) + ")"


def any_of(*tests: str) -> str:
    return "(" + " or ".join(tests) + ")"


def no(test: str) -> str:
    return f"(not {test})"


def matches(at: str, caps: Sequence[str], test: str | None = None, optional: str = "") -> str:
    """Zero or one match; ``optional`` is an array of further captures."""
    listed = f"array({', '.join(caps)})"
    if optional:
        listed = f"concat({listed}, {optional})"
    one = f"array(struct({at} as at, {listed} as caps))"
    return f"if({test}, {one}, {_NO_MATCH})" if test else one


def let(var: str, value: str, body: str) -> str:
    """Give a value a name in ``body``.

    ``get`` may always be null, so Spark needs no look into the body to know; with ``flatten``
    it asks twice at each level, and nested names would take exponential time to plan.
    """
    return f"get(transform(array({value}), {var} -> {body}), 0)"


def opens(i: str) -> str:
    return f"(left({tok(i)}, 1) in ('(', '[', '{{'))"


def closes(i: str) -> str:
    return f"(left({tok(i)}, 1) in (')', ']', '}}'))"


# --- walks over neighbouring tokens: a short reach first, then a table of the file's brackets ---

WALKED = 1 << 21  # matches times tokens of a file up to which no table is made
_BLOCK = 64  # brackets or stops of a small block; a large one has the square

#: By the SQL of a stop, the name of the table that has it.
_STOPS: dict[str, str] = {"false": "level0"}
_MATES = "mates"


def every_token() -> str:
    """Indices of the tokens."""
    low, high = f"{HEAD}", f"size(tok) - {TAIL + 1}"
    return f"if({high} >= {low}, sequence({low}, {high}), cast(array() as array<int>))"


def tables_in(sql: str) -> list[str]:
    """Names of the bracket tables that an expression looks into."""
    return sorted(set(re.findall(rf"\b(?:level\d+|{_MATES})\b", sql)))


def table(name: str) -> str:
    """SQL of a bracket table over ``tok``, one entry for each token."""
    if name == _MATES:
        return _mates()
    return _levels(next(stop for stop, known in _STOPS.items() if known == name))


def _records(stop: str, body: str) -> str:
    """``body`` over ``ev``, the tokens that are brackets or stops, ``rec``, the innermost
    bracket ``o`` open before each of them and the nearest stop or opener ``last`` at its
    depth, and ``fin``, the same for the end.

    One pass with a stack.  A closer without an opener opens nothing.  Spark copies the state
    of an aggregate at each step, so the state is the stack alone and not what was found: the
    stacks at the starts of large blocks come first, then those of small blocks within each,
    then the records of each small block.
    """
    stack = "array<struct<o:int,last:int>>"
    top, rest = "get(st, 0)", "slice(st, 2, size(st))"
    pushed = "concat(array(struct(j as o, j as last)), st)"
    popped = f"if(size(st) > 1, {rest}, array(struct({HEAD - 1} as o, {HEAD - 1} as last)))"
    marked = f"concat(array(struct({top}.o as o, j as last)), {rest})"

    def after(state: str, k: str) -> str:
        """The stack after event k."""
        closed = let("st", popped, f"if({stop}, {marked}, st)")
        step = f"case when {opens('j')} then {pushed} when {closes('j')} then {closed} else {marked} end"
        return let("st", state, let("j", f"get(ev, {k})", step))

    def events(first: str, n: int) -> str:
        return f"sequence({first}, least({first} + {n}, size(ev)) - 1)"

    def starts(state: str, first: str, blocks: str, n: int) -> str:
        """The stacks at the starts of blocks of n events, and after the last."""
        walk = f"aggregate({events(f'{first} + b * {n}', n)}, t.cur, (x, k) -> {after('x', 'k')})"
        return (
            f"aggregate({blocks}, struct({state} as cur, cast(array() as array<{stack}>) as out), "
            f"(t, b) -> struct({walk} as cur, array_append(t.out, t.cur) as out))"
        )

    small, large = _BLOCK, _BLOCK * _BLOCK
    bottom = f"cast(array(struct({HEAD - 1} as o, {HEAD - 1} as last)) as {stack})"
    whole = starts(bottom, "0", f"sequence(0, (size(ev) - 1) div {large})", large)
    own = f"sequence(0, (least(g * {large} + {large}, size(ev)) - 1 - g * {large}) div {small})"
    within = f"flatten(transform(whole.out, (y, g) -> {starts('y', f'cast(g * {large} as int)', own, small)}.out))"
    record = "cast(array() as array<struct<o:int,last:int>>)"
    each = (
        f"aggregate({events(f'cast(b * {small} as int)', small)}, struct(y as cur, {record} as out), "
        f"(t, k) -> struct({after('t.cur', 'k')} as cur, array_append(t.out, get(t.cur, 0)) as out), t -> t.out)"
    )
    some = f"filter({every_token()}, j -> {any_of(opens('j'), closes('j'), stop)})"
    found = let("rec", f"flatten(transform({within}, (y, b) -> {each}))", body)
    found = let("whole", whole, let("fin", "get(whole.cur, 0)", found))
    none = let("rec", record, let("fin", f"get({bottom}, 0)", body))
    return let("ev", some, f"if(size(ev) > 0, {found}, {none})")


def _levels(stop: str) -> str:
    """By token: ``o``, the innermost bracket open at it, and ``last``, the nearest stop or
    bracket before it at its depth."""
    before = "coalesce(get(ev, k - 1), -1)"
    each = f"transform(rec, (r, k) -> array_repeat(r, get(ev, k) - {before}))"
    end = "array_repeat(fin, size(tok) - coalesce(get(ev, size(ev) - 1), -1))"
    return _records(stop, f"concat(flatten({each}), {end})")


def _mates() -> str:
    """By token: for an opener the token that closes it, or the last one."""
    own = f"if({closes('get(ev, k)')}, r.o, {HEAD - 1})"
    pairs = f"filter(transform(rec, (r, k) -> struct({own} as o, get(ev, k) as c)), p -> p.o >= {HEAD})"
    never = f"transform(filter(ev, j -> {opens('j')}), j -> struct(j as o, {_LAST} as c))"
    first = "filter(both, (p, q) -> q = 0 or get(both, q - 1).o <> p.o)"
    each = "transform(once, (p, q) -> array_repeat(p.c, p.o - coalesce(get(once, q - 1).o, -1)))"
    dense = let("both", f"array_sort(concat({pairs}, {never}))", let("once", first, f"flatten({each})"))
    return _records("false", dense)


def _walk(start: str, step: int, hit: str, depth: str, known: str | None = None) -> str:
    """Index of the first token from ``start`` on for which ``hit`` holds.

    ``hit`` and ``depth`` see the token index j and the bracket depth s.d before it.
    Nothing found: the empty entry before the first token, or the last token of the file.
    ``known`` is the same from a table, null where the file has none.
    """
    edge, none = (f"{HEAD}", f"{HEAD - 1}") if step < 0 else (_LAST, _LAST)
    cut = "greatest" if step < 0 else "least"

    def reach(far: str) -> str:
        end = f"{cut}({start} {'-' if step < 0 else '+'} {far}, {edge})"
        some = f"{start} {'>=' if step < 0 else '<='} {end}"
        seq = f"if({some}, sequence({start}, {end}, {step}), cast(array() as array<int>))"
        return (
            f"aggregate({seq}, struct(-1 as p, 0 as d), (s, j) -> struct("
            f"if(s.p = -1 and {hit}, j, s.p) as p, if(s.p = -1, {depth}, s.d) as d), "
            f"s -> if(s.p >= 0, s.p, if({end} = {edge}, {none}, null)))"
        )

    tried = [reach("32"), *([known] if known else []), reach("size(tok)")]
    return f"coalesce({', '.join(tried)})"


def opener(i: str) -> str:
    """Index of the innermost bracket open at token i, an empty entry when there is none."""
    hit = all_of("s.d = 0", opens("j"))
    depth = f"case when {closes('j')} then s.d + 1 when {opens('j')} then s.d - 1 else s.d end"
    return _walk(f"{i} - 1", -1, hit, depth, f"get({_STOPS['false']}, {i}).o")


def closer(i: str) -> str:
    """Index of the bracket that closes the one at token i."""
    hit = all_of("s.d = 1", closes("j"))
    depth = f"case when {closes('j')} then s.d - 1 when {opens('j')} then s.d + 1 else s.d end"
    return _walk(i, 1, hit, depth, f"get({_MATES}, {i})")


def back(i: str, stop: str) -> str:
    """Nearest index before i, outside closed brackets, where ``stop`` or a bracket is."""
    hit = all_of("s.d = 0", any_of(opens("j"), stop))
    depth = f"case when {closes('j')} then s.d + 1 when s.d > 0 and {opens('j')} then s.d - 1 else s.d end"
    name = _STOPS.setdefault(stop, f"level{len(_STOPS)}")
    return _walk(f"{i} - 1", -1, hit, depth, f"get({name}, {i}).last")


def forward(i: str, last: str) -> str:
    """First index from i on, outside brackets opened since i, where ``last`` holds."""
    depth = f"s.d + if({opens('j')}, 1, if({closes('j')}, -1, 0))"
    hit = all_of(f"{depth} <= 0", last)
    return _walk(i, 1, hit, depth)


def line_ends(j: str) -> str:
    """A Python token is followed by a line end that is not escaped."""
    rest = f"regexp_replace({tok(j)}, {quoted(rf'\A(?:{tk.PY_STRING})')}, '')"
    return is_like(rest, r"(?:^|[^\\\r]|#[^\r\n]*)\r?\n")


# --- shapes --------------------------------------------------------------------------


@dataclass(frozen=True)
class Shape:
    """A named candidate match.

    ``anchor`` is the regex the anchor token begins with and ``probe`` one that a text with
    a match contains (None: any text may), both for given conditions.  ``found`` gives, for
    a language and the captures asked for, a cheap test of the neighbours and the matches.
    ``optional`` names captures that a match may lack.
    """

    name: str
    languages: tuple[str, ...]
    captures: tuple[str, ...]
    anchor: Callable[[Where, str], str]
    found: Callable[[str, frozenset[str]], tuple[str, str]]
    probe: Callable[[Where], str | None] = lambda where: None
    optional: tuple[str, ...] = ()


REGISTRY: dict[str, Shape] = {}


def register(shape: Shape) -> Shape:
    REGISTRY[shape.name] = shape
    return shape


def captures_of(shape: Shape, lang: str) -> tuple[str, ...]:
    """Captures that the matches of a shape have in one language."""
    _, found = shape.found(lang, frozenset(shape.captures))
    return tuple(c for c in shape.captures if f"{quoted(c)} as name" in found)


def _name_anchor(capture: str):
    def anchor(where: Where, lang: str) -> str:
        words = literals(where, capture)
        return _words(words) if words else tk.IDENT[lang]

    return anchor


def _name_probe(*captures: str):
    def probe(where: Where) -> str | None:
        for c in captures:
            words = literals(where, c)
            if words:
                return "(?:" + "|".join(re.escape(w) for w in words) + ")"
        return None

    return probe


def _holds_in_context(regex: str) -> bool:
    """A match inside a capture is one in the whole file too: no anchors, no look-around."""
    return not re.search(r"[\^$\\]|\(\?[=!<]", regex)


def _const(regex: str):
    return lambda where, lang: regex


def _const_probe(text_in_file: str):
    return lambda where: text_in_file


def _callable(i: str, lang: str) -> str:
    words = _PYTHON_NOT_CALLABLE if lang == "python" else _SCRIPT_NOT_CALLABLE
    return no(word(i, *words))


def _stands_alone(i: str, lang: str) -> str:
    """The name at i is no member, definition or target of ``new``."""
    if lang == "python":
        return no(begins(f"{i} - 1", r"\.|(?:def|class)\b"))
    generator = all_of(begins(f"{i} - 1", r"\*"), word(f"{i} - 2", "function"))
    before = rf"{_MEMBER}|(?:function|new|class){_WORD_END}"
    return all_of(no(begins(f"{i} - 1", before)), no(generator))


def _called(i: str, lang: str) -> str:
    """A call's bracket comes at token i (or after ``?.``)."""
    if lang == "python":
        return begins(i, r"\(")
    return any_of(
        begins(i, r"\("), all_of(begins(i, r"\?\."), begins(f"{i} + 1", r"\("))
    )


def _bracket(i: str) -> str:
    return f"if({begins(i, r'\(')}, {i}, {i} + 1)"


def _call(lang: str, needs: frozenset[str]) -> tuple[str, str]:
    test = all_of(_called("i + 1", lang), _stands_alone("i", lang), _callable("i", lang))
    return test, matches("i", [cap("fn", "''", name("i", lang))])


register(Shape("call", CODE, ("fn",), _name_anchor("fn"), _call, _name_probe("fn")))


def _member_call(lang: str, needs: frozenset[str]) -> tuple[str, str]:
    test = all_of(
        begins("i + 1", _MEMBER),
        is_name("i + 2", lang),
        _called("i + 3", lang),
        _stands_alone("i", lang),
        _callable("i", lang),
    )
    second = "method" if lang == "python" else "prop"
    caps = [
        cap("obj", "''", name("i", lang)),
        cap(second, text("i", "i + 2"), name("i + 2", lang)),
    ]
    optional = ""
    if "args" in needs:
        caps.append(cap("args", text("i", "b"), span("b", "e", lang)))
    if "arg" in needs:
        first = cap("arg", text("i", "b + 1"), core("b + 1", lang))
        optional = f"if({begins('b + 1', tk.STRING[lang])}, array({first}), array())"
    found = matches("i", caps, optional=optional)
    if "args" in needs:
        found = let("e", closer("b"), found)
    if needs & {"args", "arg"}:
        found = let("b", _bracket("i + 3"), found)
    return test, found


register(
    Shape(
        "member_call",
        CODE,
        ("obj", "prop", "method", "args", "arg"),
        _name_anchor("obj"),
        _member_call,
        _name_probe("obj", "prop", "method"),
        optional=("arg",),
    )
)

_PLAIN_ASSIGN = r"=(?![=>])"


def _value_ends(i: str) -> str:
    """The expression made of the single token i ends there."""
    broken = all_of(is_like(tok(i), r"[\r\n]\s*\z"), begins(f"{i} + 1", r"[\w$}@#]"))
    return any_of(begins(f"{i} + 1", r"[;,)\]}]|\z"), broken)


def _member_assign(lang: str, needs: frozenset[str]) -> tuple[str, str]:
    test = all_of(begins("i - 1", r"\.(?!\.)"), begins("i + 1", _PLAIN_ASSIGN))
    return test, matches("i", [cap("prop", "''", name("i", lang))])


def _member_assign_string(lang: str, needs: frozenset[str]) -> tuple[str, str]:
    test = all_of(
        begins("i - 1", r"\.(?!\.)"),
        begins("i + 1", _PLAIN_ASSIGN),
        begins("i + 2", tk.JS_STRING),
        _value_ends("i + 2"),
    )
    value = cap("value", text("i", "i + 2"), core("i + 2", lang))
    return test, matches("i", [cap("prop", "''", name("i", lang)), value])


for _name, _found, _caps in (
    ("member_assign", _member_assign, ("prop",)),
    ("member_assign_string", _member_assign_string, ("prop", "value")),
):
    register(Shape(_name, SCRIPT, _caps, _name_anchor("prop"), _found, _name_probe("prop")))


def _member_chain(lang: str, needs: frozenset[str]) -> tuple[str, str]:
    test = all_of(
        begins("i + 1", _MEMBER),
        is_name("i + 2", lang),
        begins("i + 3", _MEMBER),
        begins("i + 4", rf"#?{tk.JS_IDENT}"),
        no(begins("i - 1", _MEMBER)),
        _callable("i", lang),
    )
    prop = cap("prop", text("i", "i + 2"), name("i + 2", lang))
    return test, matches("i", [cap("obj", "''", name("i", lang)), prop])


register(
    Shape(
        "member_chain",
        SCRIPT,
        ("obj", "prop"),
        _name_anchor("obj"),
        _member_chain,
        _name_probe("obj", "prop"),
    )
)

_DECLARES = ("const", "let", "var")


def _declarator_number(lang: str, needs: frozenset[str]) -> tuple[str, str]:
    declared, listed = word("i - 3", *_DECLARES), begins("i - 3", ",")
    test = all_of(
        begins("i - 1", _PLAIN_ASSIGN),
        is_name("i - 2", lang),
        any_of(declared, listed),
        _value_ends("i"),
    )
    new_line = all_of(
        is_like(tok("j - 1"), r"[\r\n]\s*\z"),
        is_like(core("j - 1", lang), _VALUE_END),
        begins("j", r"[\w$]"),
    )
    head = back("i - 3", any_of(begins("j", ";"), word("j", *_DECLARES), new_line))
    found = matches("i", [cap("num", "''", core("i", lang))], word("h", *_DECLARES))
    return test, let("h", f"if({declared}, i - 3, {head})", found)


register(
    Shape(
        "declarator_number",
        SCRIPT,
        ("num",),
        _const(r"\.?\d"),
        _declarator_number,
        _const_probe(r"\d"),
    )
)


def _call_arg_string(last: bool):
    def found(lang: str, needs: frozenset[str]) -> tuple[str, str]:
        test = all_of(_called("i + 1", lang), _stands_alone("i", lang), _callable("i", lang))
        alone = all_of(
            begins("a", tk.JS_STRING), begins("a - 1", r"[(,]"), begins("a + 1", r"[),]")
        )
        got = matches("i", [cap("fn", "''", name("i", lang))], alone)
        if not last:
            return test, let("a", f"{_bracket('i + 1')} + 1", got)
        at = f"if({begins('e - 1', ',')}, e - 2, e - 1)"
        return test, let("e", closer(_bracket("i + 1")), let("a", at, got))

    return found


for _name, _last in (("call_last_arg_string", True), ("call_first_arg_string", False)):
    register(
        Shape(
            _name, SCRIPT, ("fn",), _name_anchor("fn"), _call_arg_string(_last), _name_probe("fn")
        )
    )


def _jsx_attr(lang: str, needs: frozenset[str]) -> tuple[str, str]:
    test = all_of(
        begins("i - 1", rf"{tk.JS_IDENT}|\}}|[\"']"),
        no(word("i - 1", *_DECLARES, "return", "typeof", "case", "else", "do")),
        begins("i + 1", _PLAIN_ASSIGN),
        begins("i + 2", r"[{\"']"),
    )
    return test, matches("i", [cap("attr", "''", name("i", lang))])


register(
    Shape(
        "jsx_attr", ("javascript",), ("attr",), _name_anchor("attr"), _jsx_attr, _name_probe("attr")
    )
)


def _import_source(lang: str, needs: frozenset[str]) -> tuple[str, str]:
    whole = core("i", lang)
    plain = is_like(whole, r"\A.[^\\]+.\z")
    test = all_of(word("i - 1", "import", "from"), plain)
    head = back("i - 1", any_of(word("j", "import", "export"), begins("j", ";")))
    inner = f"substring({whole}, 2, length({whole}) - 2)"
    found = matches("i", [cap("src", f"left({tok('i')}, 1)", inner)], word("h", "import"))
    return test, let("h", f"if({word('i - 1', 'import')}, i - 1, {head})", found)


register(
    Shape(
        "import_source", SCRIPT, ("src",), _const(r"[\"']"), _import_source, _const_probe("import")
    )
)


def _call_template_arg(lang: str, needs: frozenset[str]) -> tuple[str, str]:
    test = all_of(begins("i - 1", r"[(,]"), begins("i + 1", r"[),]"))
    called = all_of(
        begins("o", r"\("),
        begins("o - 1", rf"{tk.JS_IDENT}|[)\]]|\?\."),
        _callable("o - 1", lang),
        no(word("o - 2", "function")),
        no(is_like(text("greatest(o - 24, 0)", "o"), r"\bnew\s+[\w$.\s]+\z")),
    )
    found = matches("i", [cap("sql", "''", core("i", lang))], called)
    return test, let("o", opener("i"), found)


register(
    Shape(
        "call_template_arg", SCRIPT, ("sql",), _const("`"), _call_template_arg, _const_probe("`")
    )
)


def _catch_empty(lang: str, needs: frozenset[str]) -> tuple[str, str]:
    test = all_of(begins("i - 1", r"\}"), begins("i + 1", r"[({]"))
    body = f"if({begins('i + 1', r'\{')}, i + 1, {closer('i + 1')} + 1)"
    empty = all_of(begins("b", r"\{"), begins("b + 1", r"\}"))
    found = matches("i", [cap("empty_body", text("i", "b"), span("b", "b + 1", lang))], empty)
    return test, let("b", body, found)


register(
    Shape(
        "catch_empty",
        SCRIPT,
        ("empty_body",),
        _const(_words(["catch"])),
        _catch_empty,
        _const_probe("catch"),
    )
)


def _comment(lang: str, needs: frozenset[str]) -> tuple[str, str]:
    marks = "#" if lang == "python" else r"//|/\*"
    leading = all_of(f"i = {HEAD}", begins("i", rf"\s|{marks}"))
    trivia = f"substring({tok('i')}, length(c) + 1)"
    parts = f"regexp_extract_all({trivia}, {quoted(rf'{tk.COMMENT[lang]}|(?s:.)[^/#]*+')}, 0)"
    lead = "concat(c, array_join(slice(p, 1, k), ''))"
    one = f"struct(i as at, array({cap('comment', lead, 'x')}) as caps)"
    kept = is_like("m.caps[0].text", rf"\A(?:{marks})")
    found = f"filter(transform(p, (x, k) -> {one}), m -> {kept})"
    return "true", let("c", f"if({leading}, '', {core('i', lang)})", let("p", parts, found))


def _comment_probe(where: Where) -> str | None:
    for c in where:
        if c.op == "match" and _holds_in_context(c.value):
            return c.value
        if c.op == "eq":
            return re.escape(c.value)
    return None


register(
    Shape(
        "comment",
        CODE,
        ("comment",),
        lambda where, lang: r"[^#]*+#" if lang == "python" else r"(?s:.*?)/[/*]",
        _comment,
        _comment_probe,
    )
)


def _stmt_keyword(lang: str, needs: frozenset[str]) -> tuple[str, str]:
    keyword = cap("keyword", "''", name("i", lang))
    if lang == "python":
        end = forward("i", any_of(line_ends("j"), begins("j + 1", ";")))
        found = matches("i", [cap("statement", "''", span("i", "e", lang)), keyword])
        return no(begins("i - 1", r"\.")), let("e", end, found)
    test = all_of(no(begins("i - 1", _MEMBER)), no(begins("i + 1", r"[:=(.]")))
    end = f"if({begins('i + 1', ';')}, i + 1, i)"
    found = matches("i", [cap("statement", "''", span("i", "e", lang)), keyword])
    return test, let("e", end, found)


def _keyword_anchor(where: Where, lang: str) -> str:
    known = ["assert", "global"] if lang == "python" else ["debugger"]
    return _words(literals(where, "keyword") or known)


register(
    Shape(
        "stmt_keyword",
        CODE,
        ("statement", "keyword"),
        _keyword_anchor,
        _stmt_keyword,
        _name_probe("keyword"),
    )
)


def _except_bare(lang: str, needs: frozenset[str]) -> tuple[str, str]:
    def indent(j: str) -> str:
        return f"length(regexp_extract({tok(f'{j} - 1')}, '[^\\\\r\\\\n]*\\\\z', 0))"

    last = all_of("j > i + 1", line_ends("j"), f"{indent('j + 1')} <= w")
    found = matches("i", [cap("bare_except", "''", span("i", "e", lang))])
    return begins("i + 1", ":"), let("w", indent("i"), let("e", forward("i", last), found))


register(
    Shape(
        "except_bare",
        ("python",),
        ("bare_except",),
        _const(_words(["except"])),
        _except_bare,
        _const_probe("except"),
    )
)


def _kwarg_true(lang: str, needs: frozenset[str]) -> tuple[str, str]:
    test = all_of(
        begins("i - 1", r"[(,]"),
        begins("i + 1", _PLAIN_ASSIGN),
        word("i + 2", "True"),
        begins("i + 3", r"[),]"),
    )
    called = all_of(
        begins("o", r"\("),
        begins("o - 1", rf"{tk.PY_IDENT}|[)\]]"),
        _callable("o - 1", lang),
        no(word("o - 2", "def", "class")),
    )
    found = matches("i", [cap("kw", "''", name("i", lang))], called)
    return test, let("o", opener("i"), found)


register(
    Shape("kwarg_true", ("python",), ("kw",), _name_anchor("kw"), _kwarg_true, _name_probe("kw"))
)


def _assign_string(lang: str, needs: frozenset[str]) -> tuple[str, str]:
    starts = any_of(
        begins("i - 1", r"\z|[;:]|=(?!=)"),
        all_of(no(begins("i - 1", r"[(,\[{.*]")), line_ends("i - 1")),
        all_of(f"i = {HEAD + 1}", begins("i - 1", r"[\s#]")),
    )
    typed = all_of(begins("i + 1", ":(?!=)"), no(line_ends("i + 1")), _callable("i", lang))
    test = all_of(any_of(begins("i + 1", _PLAIN_ASSIGN), typed), starts)
    sign = forward("i + 2", any_of(begins("j", _PLAIN_ASSIGN), line_ends("j")))
    whole = all_of(
        begins("e", _PLAIN_ASSIGN),
        begins("e + 1", tk.PY_STRING),
        any_of(begins("e + 2", r"\z|;"), line_ends("e + 1")),
    )
    # after a colon: the body of a one-line statement, not the type of a name
    head = back("i", any_of(f"j = {HEAD}", line_ends("j - 1"), begins("j", ";")))
    body = any_of(no(begins("i - 1", ":")), word("h", *_PYTHON_HEADS))
    found = matches("i", [cap("name", "''", name("i", lang))], all_of(whole, body))
    found = let("h", f"if({begins('i - 1', ':')}, {head}, i)", found)
    return test, let("e", f"if({typed}, {sign}, i + 1)", found)


def _assign_probe(where: Where) -> str | None:
    words = _name_probe("name")(where)
    if words:
        return words
    for c in where:
        if c.capture == "name" and c.op == "match" and _holds_in_context(c.value):
            return c.value
    return None


register(
    Shape(
        "assign_string", ("python",), ("name",), _name_anchor("name"), _assign_string, _assign_probe
    )
)


def _conditional_head(colon: str) -> str:
    """Index of the token that tells whether a colon belongs to ``c ? a : b``."""
    return back(colon, begins("j", r"[,;]|\?(?!\.)|=(?!=)|:"))


def _is_conditional(head: str, colon: str) -> str:
    return all_of(begins(head, r"\?(?![.?])"), f"{head} < {colon} - 1")


def _type_annotation(lang: str, needs: frozenset[str]) -> tuple[str, str]:
    test = all_of(
        begins("i - 1", ":"),
        begins("i - 2", rf"{tk.JS_IDENT}|[)\]}}?!\"']"),
        no(begins("i + 1", r"[\[|&.<(]|(?:extends|is)\b")),
        no(word("i - 2", "case", "default")),
    )
    typed = is_like(
        text("greatest(o - 12, 0)", "o"), r"\b(?:type|interface)\s[^;{}]*=\s*\z"
    )
    in_object = all_of(
        begins("o", r"\{"), begins("o - 1", r"[(\[]|=(?![=>])|return\b"), no(typed)
    )
    plain = all_of(no(_is_conditional("h", "i - 1")), no(in_object))
    found = matches("i", [cap("type", "''", name("i", lang))], plain)
    return test, let("h", _conditional_head("i - 1"), let("o", opener("i"), found))


def _as_type(lang: str, needs: frozenset[str]) -> tuple[str, str]:
    test = all_of(
        word("i - 1", "as"),
        is_like(core("i - 2", lang), _VALUE_END),
        no(begins("i + 1", r"[\[|&.<]")),
    )
    named = all_of(begins("o", r"\{"), word("o - 1", "import", "export", "type"))
    found = matches("i", [cap("type", "''", name("i", lang))], no(named))
    return test, let("o", opener("i"), found)


def _type_anchor(where: Where, lang: str) -> str:
    return _words(literals(where, "type") or _PREDEFINED_TYPES)


for _name, _found in (("type_annotation", _type_annotation), ("as_type", _as_type)):
    register(
        Shape(_name, ("typescript",), ("type",), _type_anchor, _found, _name_probe("type"))
    )


def _operand_start(i: str) -> str:
    """First token of the member, call or index chain that ends before token i.

    State k says what may come next on the way back: v a value, c a callee or a dot,
    d only a dot, b the inside of brackets, x nothing.
    """
    left, right, dot = opens("j"), closes("j"), begins("j", _MEMBER)
    value_word = all_of(
        begins("j", rf"#?{tk.JS_IDENT}|[\"'`\d]"),
        any_of(_callable("j", "typescript"), word("j", "this", "super")),
    )
    value = "s.k in ('v', 'c')"
    edge = f"(s.d = 1 and {left})"
    k = (
        f"case when s.k = 'x' then 'x' when s.d > 0 then if({edge}, 'c', s.k) "
        f"when {value} and {right} then 'b' when {value} and {value_word} then 'd' "
        f"when {value} and {begins('j', '!(?!=)')} then 'v' "
        f"when s.k in ('c', 'd') and {dot} then 'v' else 'x' end"
    )
    d = (
        f"case when s.k = 'x' then s.d when (s.d > 0 or {value}) and {right} then s.d + 1 "
        f"when s.d > 0 and {left} then s.d - 1 else s.d end"
    )
    p = (
        f"case when s.k = 'x' then s.p when s.d > 0 then if({edge}, j, s.p) "
        f"when {value} and {value_word} then j "
        f"when s.k in ('c', 'd') and {word('j', 'new')} then j else s.p end"
    )

    def reach(far: str) -> str:
        low = f"greatest({i} - 1 - {far}, {HEAD})"
        seq = f"if({i} - 1 >= {low}, sequence({i} - 1, {low}, -1), cast(array() as array<int>))"
        return (
            f"aggregate({seq}, struct(-1 as p, 0 as d, 'v' as k), "
            f"(s, j) -> struct({p} as p, {d} as d, {k} as k), "
            f"s -> if(s.k = 'x' or {low} = {HEAD}, s.p, null))"
        )

    return f"coalesce({reach('32')}, {reach('size(tok)')})"


def _non_null(lang: str, needs: frozenset[str]) -> tuple[str, str]:
    spread = all_of(
        begins("i + 1", r"[\w$\"'`#!({\[]|\+\+|--"),
        no(begins("i + 1", r"(?:as|in|of|instanceof|is|satisfies)" + _WORD_END)),
    )
    # "(x) !y" negates y; "f!(x)" and "a![0]" use the value
    used = all_of(begins("i + 1", r"[(\[]"), no(begins("i - 1", r"\)")))
    broken = is_like(tok("i"), r"[\r\n]\s*\z")
    test = all_of(
        is_like(core("i - 1", lang), r"[\w$)\]\"'`]$"),
        no(is_like(tok("i - 1"), r"[\r\n]\s*\z")),
        any_of(_callable("i - 1", lang), word("i - 1", "this", "super")),
        any_of(no(spread), used, broken),
    )
    definite = all_of(begins("i + 1", ":"), no(_is_conditional("h", "i + 1")))
    whole = f"concat({text('s0', 'i')}, '!')"
    found = matches("s0", [cap("expr", "''", whole)], all_of("s0 >= 0", no(definite)))
    head = f"if({begins('i + 1', ':')}, {_conditional_head('i + 1')}, i)"
    return test, let("h", head, let("s0", _operand_start("i"), found))


register(
    Shape(
        "non_null", ("typescript",), ("expr",), _const(r"!(?!=)"), _non_null, _const_probe("!")
    )
)

# --- HTML ----------------------------------------------------------------------------

_ATTR_NAME = r"""[^\s"'<>/=]++"""
_ATTR_HEAD = rf"{_ATTR_NAME}\s*+=\s*+"


def _html_name() -> str:
    return f"regexp_extract({tok('i')}, {quoted(rf'\A{_ATTR_NAME}')}, 0)"


def _html_attr(lang: str, needs: frozenset[str]) -> tuple[str, str]:
    return "true", matches("i", [cap("attr", "''", _html_name())])


def _html_valued(with_quotes: bool):
    mark = r"""["']""" if with_quotes else ""
    test = begins("i", rf"""{_ATTR_HEAD}{mark or r'''[^"']'''}""")

    def found(lang: str, needs: frozenset[str]) -> tuple[str, str]:
        lead = f"regexp_extract({tok('i')}, {quoted(rf'\A{_ATTR_HEAD}{mark}')}, 0)"
        size = f"length({tok('i')}) - length(l)" + (" - 1" if with_quotes else "")
        value = cap("val", "l", f"substring({tok('i')}, length(l) + 1, {size})")
        caps = [cap("attr", "''", _html_name()), value]
        return test, let("l", lead, matches("i", caps, f"{size} > 0"))

    return found


def _html_anchor(where: Where, lang: str) -> str:
    words = literals(where, "attr")
    if words:
        return "(?:" + "|".join(re.escape(w) for w in words) + r""")(?![^\s"'<>/=])"""
    return r"""[^\s"'<>/=]"""


for _name, _found, _caps in (
    ("html_attr", _html_attr, ("attr",)),
    ("html_attr_quoted", _html_valued(True), ("attr", "val")),
    ("html_attr_unquoted", _html_valued(False), ("attr", "val")),
):
    register(Shape(_name, ("html",), _caps, _html_anchor, _found, _name_probe("attr")))

# Shapes that look at attribute tokens only.
ATTRIBUTE_SHAPES = ("html_attr", "html_attr_quoted", "html_attr_unquoted")


def _html_tag(lang: str, needs: frozenset[str]) -> tuple[str, str]:
    tag = f"substring(regexp_extract({tok('i')}, {quoted(r'\A<[^\s/>]++')}, 0), 2)"
    return "true", matches("i", [cap("tag", "'<'", tag)])


def _html_comment(lang: str, needs: frozenset[str]) -> tuple[str, str]:
    return "true", matches("i", [cap("comment", "''", tok("i"))])


register(
    Shape("html_tag", ("html",), ("tag",), _const("<[A-Za-z]"), _html_tag, _name_probe("tag"))
)
register(
    Shape(
        "html_comment", ("html",), ("comment",), _const("<!--"), _html_comment, _const_probe("<!--")
    )
)
