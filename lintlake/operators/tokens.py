"""Tokens of a source text, kept as an array inside the file's row.

``regexp_extract_all`` with a *total* regex (every character belongs to a token)
turns a file into an array of strings in one JVM pass.  A token is its core plus
all white space and comments that follow it, so the neighbours of a core are the
neighbouring array entries, and the text before token ``i`` is the concatenation
of the entries before it.  White space and comments at the start of a file form
one token without a core.

All loops in the regexes are possessive: Java matches those without recursion, so
a very long literal cannot overflow the stack.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.sources.storage import shared_folder, stored

# Java looks single Latin-1 characters of a class up in one table, ranges one by one; so
# the classes of the hot loops list their characters, and the rest of Unicode is apart.
_SPACE_CHARS = r" \t\n\r\f\x0B\xA0"
_SPACE_HIGH = r"\x{2028}\x{2029}\x{FEFF}"
_SPACE = rf"(?:[{_SPACE_CHARS}]++|[{_SPACE_HIGH}])"
_LETTERS = string.ascii_letters + "_" + "".join(rf"\x{n:02X}" for n in range(0x80, 0x100) if n != 0xA0)
_HIGH = rf"[\x{{100}}-\x{{10FFFF}}&&[^{_SPACE_HIGH}]]"


def _ident(more: str) -> str:
    letters = _LETTERS + more
    return rf"(?:[{letters}]|{_HIGH})(?:[{letters}{string.digits}]++|{_HIGH})*+"


_STR2 = r'"[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+"'
_STR1 = r"'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'"
_NUMBER = (
    r"0[xX][0-9a-fA-F_]++n?|0[bBoO][0-7_]++n?"
    r"|(?:\d[\d_]*+(?:\.[\d_]*+)?+|\.\d[\d_]*+)(?:[eE][+-]?\d++)?+[nNjJ]?"
)

JS_IDENT = _ident("$")
JS_STRING = rf"(?:{_STR2}|{_STR1})"
JS_COMMENT = r"//[^\r\n]*+|/\*(?s:.*?)\*/"
JS_TEMPLATE = (
    r"`(?:[^`\\$]++|\\(?s:.)|\$\{(?:[^`{}]++|\{[^{}]*+\}|`(?:[^`\\]++|\\(?s:.))*+`)*+\}|\$)*+`"
)
# A slash opens a regex literal after an operator, an opener or one of these words.
_JS_REGEX = (
    r"/(?![*/])(?<=(?:^|=>|[(,=:\[!&|?{};+\-*%~^]"
    r"|\b(?:return|typeof|case|in|of|delete|void|throw|new|do|else|await|yield))\s{0,20}/)"
    r"(?:[^/\\\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*+\])++/[A-Za-z]*+"
)
_JS_OPERATOR = (
    r"\?\.(?!\d)|=>|\.\.\.|[=!]==?|>>>?=?|<<=?|<=|>=|\*\*=?|&&=?|\|\|=?|\?\?=?"
    r"|\+\+|--|[-+*/%&|^]="
)
# the most frequent kind of token comes first
JS_CORE = (
    rf"#?{JS_IDENT}|{JS_STRING}|{JS_TEMPLATE}|{_NUMBER}|\A#![^\r\n]*+|{_JS_REGEX}"
    rf"|{_JS_OPERATOR}|(?s:.)"
)
_JS_TRIVIA = rf"(?:{_SPACE}|{JS_COMMENT})"

PY_IDENT = _ident("")
PY_STRING = (
    r"[rRbBuUfF]{0,2}(?:"
    r'"""(?:[^"\\]++|\\(?s:.)|"(?!""))*+"""'
    r"|'''(?:[^'\\]++|\\(?s:.)|'(?!''))*+'''"
    rf"|{_STR2}|{_STR1})"
)
PY_COMMENT = r"#[^\r\n]*+"
PY_CORE = (
    rf"(?![rRbBuUfF]{{1,2}}[\"']){PY_IDENT}|{PY_STRING}|{_NUMBER}"
    r"|->|:=|\.\.\.|\*\*=?|//=?|>>=?|<<=?|[-+*/%&|^@=!<>]=|(?s:.)"
)
_PY_TRIVIA = rf"(?:{_SPACE}|{PY_COMMENT}|\\\r?\n)"

# HTML: comment, element with a raw body up to its end tag, tag, declaration, text.
_TAG_REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
HTML_COMMENT = r"<!--(?s:.*?)(?:-->|\z)"
HTML_OPEN_TAG = rf"<[A-Za-z]{_TAG_REST}"
HTML_TOKEN = (
    rf"{HTML_COMMENT}"
    rf"|(?i:<(script|style)(?=[\s/>]){_TAG_REST}(?s:.*?)(?=</\1[\s/>]|\z))"
    rf"|{HTML_OPEN_TAG}|</[A-Za-z][^>]*+>|<![^>]*+>|[^<]++|<"
)
_ATTR_NAME = r"""[^\s"'<>/=]++"""
HTML_ATTR = rf"""{_ATTR_NAME}(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>=]++))?+"""
# Pieces of one open tag (and its raw body): name, space, attributes, end, body.
HTML_TAG_PIECE = rf"""\A<[^\s/>]++|\s++|/?>(?s:.*+)|{HTML_ATTR}|(?s:.)"""

_TOKEN = {
    "javascript": rf"\A{_JS_TRIVIA}++|(?:{JS_CORE}){_JS_TRIVIA}*+",
    "typescript": rf"\A{_JS_TRIVIA}++|(?:{JS_CORE}){_JS_TRIVIA}*+",
    "python": rf"\A{_PY_TRIVIA}++|(?:{PY_CORE}){_PY_TRIVIA}*+",
}
CORE = {"javascript": JS_CORE, "typescript": JS_CORE, "python": PY_CORE}
IDENT = {"javascript": JS_IDENT, "typescript": JS_IDENT, "python": PY_IDENT}
COMMENT = {"javascript": JS_COMMENT, "typescript": JS_COMMENT, "python": PY_COMMENT}
STRING = {"javascript": JS_STRING, "typescript": JS_STRING, "python": PY_STRING}


def code_tokens(src: Column, language: str) -> Column:
    """ARRAY<STRING> of the tokens of ``src``; their concatenation is ``src``."""
    return F.regexp_extract_all(src, F.lit(_TOKEN[language]), F.lit(0))


def html_tokens(src: Column) -> Column:
    """ARRAY<STRUCT<attr BOOLEAN, t STRING>>; the concatenation of ``t`` is ``src``."""
    plain = F.regexp_extract_all(src, F.lit(HTML_TOKEN), F.lit(0))

    def piece(p: Column) -> Column:
        is_attr = p.rlike(r"""^[^\s<>/="']""")
        return F.struct(is_attr.alias("attr"), p.alias("t"))

    def split(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit(HTML_TAG_PIECE), F.lit(0))
        whole = F.array(F.struct(F.lit(False).alias("attr"), t.alias("t")))
        return F.when(t.rlike("^<[A-Za-z]"), F.transform(pieces, piece)).otherwise(whole)

    return F.flatten(F.transform(plain, split))


def newlines(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def last_line_bytes(text: Column) -> Column:
    return F.octet_length(F.substring_index(text, "\n", -1))


# --- tokens as rows -------------------------------------------------------------------

LONG_BYTES = 4 << 20  # a longer text is cut into pieces
PIECE_TOKENS = 4096
_ROWS = 100_000  # token rows that leave a task at once


def _pieces(src: Column, language: str, tokens: int) -> Column:
    """The text in pieces of about ``tokens`` whole tokens.

    No piece starts with a character that the tokens before it decide the meaning of, so a
    piece has the same tokens by itself.
    """
    token = _TOKEN[language]
    piece = rf"(?:{token}){{1,{tokens}}}+(?:(?=[/#\"'])(?:{token}))*+"
    return F.regexp_extract_all(src, F.lit(piece), F.lit(0))


def _cut(cutter: Callable[[str], Column]) -> Column:
    """What ``cutter`` makes of a text in its language."""
    language, out = F.col("language"), None
    for name in _TOKEN:
        test = language == name
        out = F.when(test, cutter(name)) if out is None else out.when(test, cutter(name))
    return out


def _numbered(pieces: DataFrame, by: list[str]) -> DataFrame:
    """The tokens of each piece with what comes before them in it: tokens (``k``), bytes
    (``at``), line ends (``nl``) and the byte after the last of these (``line_at``).

    A piece's tokens lie one after the other in its batch, so all of it is read off their
    places there: no row is sorted or moved to another task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, keys = batch.column(batch.num_columns - 1), batch.columns[:-1]
            first = tokens.offsets.to_numpy()
            values = tokens.values.cast(pa.large_binary())
            size = len(values) + 1
            begin = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + size]
            body = values.buffers()[2]
            ends = np.flatnonzero(np.frombuffer(body, np.uint8) == 10) if body else np.zeros(0, np.int64)
            piece = np.repeat(np.arange(len(tokens)), np.diff(first))
            for i in range(0, len(piece), _ROWS):
                of = piece[i : i + _ROWS]
                t = np.arange(first[0] + i, first[0] + i + len(of))
                start, here = begin[first[of]], begin[t]
                before = np.searchsorted(ends, here)
                nl = before - np.searchsorted(ends, start)
                line_at = np.append(ends, -1)[before - 1] + 1 - start
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.take(pa.array(of)) for c in keys),
                        pa.array((t - first[of]).astype(np.int64)),
                        tokens.values.slice(first[0] + i, len(of)),
                        pa.array(here - start),
                        pa.array(nl.astype(np.int64)),
                        pa.array(line_at, mask=nl == 0),
                    ],
                    names=[*by, "language", "k", "text", "at", "nl", "line_at"],
                )

    types = dict(pieces.dtypes)
    keys = ", ".join(f"{c} {types[c]}" for c in (*by, "language"))
    cut = _cut(lambda name: code_tokens(F.col("piece"), name)).alias("tokens")
    schema = f"{keys}, k bigint, text string, at bigint, nl bigint, line_at bigint"
    return pieces.select(*by, "language", cut).mapInArrow(run, schema)


def _measures(text: str) -> dict[str, Column]:
    n = newlines(F.col(text))
    return {"bytes": F.octet_length(text).cast("bigint"), "ends": n.cast("bigint"), "tail": last_line_bytes(F.col(text))}


def _before(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Sums over the rows of a group that come before each of them."""
    earlier = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)))
    line_at = F.when(F.col("ends") > 0, F.col("at") + F.col("bytes") - F.col("tail"))
    return rows.withColumns(
        {
            "nl": F.coalesce(F.sum("ends").over(earlier), F.lit(0)),
            "line_at": F.max(line_at).over(earlier),
        }
    )


def token_rows(
    corpus: DataFrame, long_bytes: int = LONG_BYTES, piece_tokens: int = PIECE_TOKENS
) -> DataFrame:
    """``path, language, token_no, at, line, col, text``: each token of the code files.

    ``at`` is the byte offset, ``line`` and ``col`` are the 1-based line and byte column.  A
    text up to ``long_bytes`` is one task's work.  A longer one is cut into pieces at token
    borders, one pass that keeps nothing but the pieces, and its pieces are dealt out to all
    tasks; totals of pieces are summed up over the file, tokens within their piece.  The rows
    are the same either way.  Paths are unique; a null text has no tokens.
    """
    code = corpus.withColumn("language", F.lower("language")).where(F.col("language").isin(list(_TOKEN)))
    is_long = F.octet_length("src") > long_bytes
    columns = ["path", "language", "token_no", "at", "line", "col", "text"]

    short = code.where(~is_long).select("path", "language", F.col("src").alias("piece"))
    short = _numbered(short.repartition("path"), ["path"]).select(
        "path",
        "language",
        F.col("k").alias("token_no"),
        "at",
        (F.col("nl") + 1).alias("line"),
        (F.col("at") - F.coalesce("line_at", F.lit(0)) + 1).alias("col"),
        "text",
    )

    cut = _cut(lambda name: _pieces(F.col("src"), name, piece_tokens))
    pieces = code.where(is_long).select("path", "language", F.posexplode(cut).alias("p", "piece"))
    pieces = stored(pieces.repartition("path", "p"), f"{shared_folder(corpus.sparkSession)}/pieces")
    tokens = F.size(_cut(lambda name: code_tokens(F.col("piece"), name))).cast("bigint")
    totals = pieces.select(
        "path", "p", tokens.alias("tokens"), *[c.alias(n) for n, c in _measures("piece").items()]
    )
    totals = _before(totals, ["path"], "p")
    earlier = Window.partitionBy("path").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "path",
        "p",
        F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("p_no"),
        F.col("at").alias("p_at"),
        F.col("nl").alias("p_nl"),
        F.col("line_at").alias("p_line_at"),
    )
    # totals meet the pieces, which are far fewer and smaller than the rows of their tokens
    dealt = pieces.repartition("path", "p").join(totals, ["path", "p"])
    rows = _numbered(dealt, ["path", "p_no", "p_at", "p_nl", "p_line_at"])
    at = F.col("p_at") + F.col("at")
    line_at = F.coalesce(F.col("p_at") + F.col("line_at"), F.col("p_line_at"), F.lit(0))
    long = rows.select(
        "path",
        "language",
        (F.col("p_no") + F.col("k")).alias("token_no"),
        at.alias("at"),
        (F.col("p_nl") + F.col("nl") + 1).alias("line"),
        (at - line_at + 1).alias("col"),
        "text",
    )
    return short.select(*columns).unionByName(long.select(*columns))
