"""Column functions: paths, text, hashes, policies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintlake import schemas


def file_extension(path: Column) -> Column:
    """Lower-case extension without the dot; null for ``test`` and ``.hidden``."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.when(
        name.rlike(r"^.+\.[^.]*$") & (name != ".."), F.lower(F.substring_index(name, ".", -1))
    )


def language_of(path: Column) -> Column:
    """Language by extension in any case, else null."""
    pairs = [F.lit(x) for kv in schemas.EXTENSION_LANGUAGE.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), file_extension(path))


def is_supported_file(path: Column) -> Column:
    known = file_extension(path).isin(*schemas.EXTENSION_LANGUAGE)
    return F.coalesce(known, F.lit(False))


def normalize_path(path: Column) -> Column:
    """Backslashes to slashes."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def lines_of(src: Column) -> Column:
    """Lines without their ends; the empty piece after a last line end is no line."""
    parts = F.split(src, r"\r?\n")
    size = F.size(parts)
    keep = F.when(F.get(parts, size - 1) == "", size - 1).otherwise(size)
    return F.slice(parts, F.lit(1), keep)


def extract_snippet(src: Column, start_line: Column, end_line: Column) -> Column:
    """Lines start..end, 1-based and inclusive, joined by line feeds; clipped at the end."""
    lines = lines_of(src)
    start = F.greatest(start_line, F.lit(1))
    count = F.greatest(F.least(end_line, F.size(lines)) - start + 1, F.lit(0))
    return F.array_join(F.slice(lines, start, count), "\n")


def truncate(text: Column, max_len: int) -> Column:
    """Text of at most ``max_len`` bytes as it is, else its first characters and dots."""
    cut = F.concat(F.left(text, F.lit(max(max_len - 3, 0))), F.lit("..."))
    return F.when(F.octet_length(text) <= max_len, text).otherwise(cut)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def decode_rules(content: Column) -> Column:
    """Base64 text with line ends and spaces to UTF-8 text; null when it is neither."""
    raw = F.try_to_binary(F.regexp_replace(content, r"[\n\r ]", ""), F.lit("base64"))
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def severity_order(severity: Column) -> Column:
    out = F.when(severity == "error", schemas.SEVERITY_ORDER["error"])
    for name in ("warning", "note"):
        out = out.when(severity == name, schemas.SEVERITY_ORDER[name])
    return out.otherwise(schemas.SEVERITY_ORDER_OTHER).cast("smallint")


def sarif_level(severity: Column) -> Column:
    """Severities and report levels have the same names."""
    return severity


def same_ignoring_case(a: Column, b: Column) -> Column:
    """Equality that folds ASCII letters only."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(a, upper, lower) == F.translate(b, upper, lower)


def line_as_int(line: Column) -> Column:
    """64-bit line number as INT, null when it does not fit (callers quarantine those)."""
    return line.try_cast("int")


def first_location(locations: Column) -> tuple[Column, Column]:
    """Path (``''`` without a location) and start line (null without) of a result."""
    place = F.get(locations, F.lit(0))["physicalLocation"]
    path = F.coalesce(place["artifactLocation"]["uri"], F.lit(""))
    return path, place["region"]["startLine"]


def status_text(passed: Column, findings: Column) -> Column:
    """Text of a commit status, at most 140 bytes."""
    word = F.when(passed, "passed").otherwise("failed")
    text = F.concat(
        F.lit("Scan "), word, F.lit(" — "), findings.cast("string"), F.lit(" finding(s)")
    )
    # the dash takes three bytes, all else is ASCII
    return F.when(F.octet_length(text) <= schemas.STATUS_MAX_BYTES, text).otherwise(
        F.left(text, F.lit(schemas.STATUS_MAX_BYTES - 2))
    )


def parse_policy(policy_json: Column) -> Column:
    """Policy text to ``struct<fail_on_severity array<string>, block_merge boolean>``.

    A missing field takes its own default ([] and true); any wrong type anywhere gives
    the empty policy ([] and false), which fails nothing.
    """
    doc = F.try_parse_json(policy_json)
    fails = F.try_variant_get(doc, "$.fail_on_severity", "variant")
    block = F.try_variant_get(doc, "$.block_merge", "variant")
    is_object = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    fails_type, block_type = F.schema_of_variant(fails), F.schema_of_variant(block)
    good = (
        is_object
        & (fails.isNull() | fails_type.isin("ARRAY<STRING>", "ARRAY<VOID>"))
        & (block.isNull() | (block_type == "BOOLEAN"))
    )
    # an array of nulls also has the type ARRAY<VOID>; only the empty one is a list of texts
    listed = F.try_variant_get(doc, "$.fail_on_severity", "array<string>")
    good = good & ~F.coalesce(F.exists(listed, lambda x: x.isNull()), F.lit(False))
    return F.struct(
        F.when(good, F.coalesce(listed, F.array().cast("array<string>")))
        .otherwise(F.array().cast("array<string>"))
        .alias("fail_on_severity"),
        F.when(good, F.coalesce(F.try_variant_get(doc, "$.block_merge", "boolean"), F.lit(True)))
        .otherwise(F.lit(False))
        .alias("block_merge"),
    )


def repo_display(last_scan_at: Column, passed: Column) -> tuple[Column, Column]:
    """Texts of the last scan and status columns of the repository table."""
    dash = F.lit("—")
    at = F.coalesce(F.date_format(last_scan_at, "yyyy-MM-dd HH:mm 'UTC'"), dash)
    status = F.when(passed, "✓ pass").when(~passed, "✗ fail").otherwise(dash)
    return at, status


def finding_display(severity: Column, line: Column, scan_at: Column) -> tuple[Column, ...]:
    """Texts of the severity, line and time columns of the findings table."""
    shown = F.when(severity.isin("error", "warning"), severity).otherwise("note")
    return shown, F.coalesce(line.cast("string"), F.lit("—")), F.date_format(scan_at, "MM-dd HH:mm")
