"""Benchmark decontamination: template windows joined by hash, then slots checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.sources.storage import shared_folder, stored

WINDOW = 8
STRIDE = 4
MIN_RUN = WINDOW + STRIDE - 1  # 11: any such run holds a document window
MIN_LITERALS = 6
BROADCAST_WINDOWS = 200_000

# Units that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l gal s sec min h hr hrs hour hours day days"
    " week weeks month months year years minute minutes second seconds percent usd eur gbp dollar"
    " dollars euro euros cent cents pound pounds mph kmh km2 m2 m3 hz khz mhz ghz w kw mw kwh j kj"
    " cal kcal v kv a c f k b kb mb gb tb meter meters metre metres kilometer kilometers gram grams"
    " kilogram kilograms mile miles inch inches foot feet liter liters litre litres"
).split()

NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0004"
APART, COPIED, SLOT = "0", "1", "2"  # of an aligned word: differs, same raw word, same template


def raw_form(text: Column) -> Column:
    """Lower-cased words one blank apart, without punctuation; names carry a mark.

    A name is a capitalised word that follows a lower-case letter or digit and a blank, so the
    first word of a sentence, clause or line is not one.
    """
    plain = F.translate(F.coalesce(text, F.lit("")), NAME + NUMBER + UNIT, "")
    marked = F.regexp_replace(plain, r"(?<=[\p{Ll}\p{N}] )(?=\p{Lu})", NAME)
    words = F.regexp_replace(F.lower(marked), rf"[^\p{{L}}\p{{N}}\s{NAME}]+", "")
    return F.trim(F.regexp_replace(words, r"\s+", " "))


def template_form(raw: Column) -> Column:
    """The same words with numbers, units after numbers and names as typed placeholders."""
    numbers = F.regexp_replace(raw, rf"(?<!\S){NAME}?\p{{N}}\S*", NUMBER)
    units = F.regexp_replace(numbers, rf"(?<={NUMBER} )(?:{'|'.join(UNITS)})(?!\S)", UNIT)
    return F.regexp_replace(units, rf"{NAME}\S+", NAME)


def _words(form: Column) -> Column:
    return F.filter(F.split(form, " "), lambda w: w != "")


def _unmarked(raw: str) -> Column:
    """Raw words without the marks of names."""
    return F.transform(raw, lambda w: F.translate(w, NAME, ""))


def _windows(words: Column, size: int, stride: int) -> Column:
    """``pos, h`` of the windows of ``size`` words every ``stride`` words; none in shorter texts."""
    last = F.size(words) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride)))
    return F.transform(
        F.coalesce(starts, F.array().cast("array<int>")),
        lambda i: F.struct(
            i.alias("pos"), F.xxhash64(F.lit(size), F.slice(words, i + 1, size)).alias("h")
        ),
    )


def _spans(codes: Column, least: Column) -> Column:
    """``start, size, copy`` of the runs of ``least`` equal words or more.

    A run with SLOT at an end that is no end of the item comes without these words too.
    """
    at = F.sequence(F.lit(0), F.length(codes) - 1)
    code = lambda i: F.substring(codes, i + 1, F.lit(1))
    first = F.filter(at, lambda i: (code(i) != APART) & ((i == 0) | (code(i - 1) == APART)))

    def run(i: Column) -> Column:
        own = F.regexp_extract(F.substring(codes, i + 1, F.length(codes)), f"^[^{APART}]+", 0)
        left = F.when(i > 0, F.ltrim(own, F.lit(SLOT))).otherwise(own)
        last = i + F.length(own) == F.length(codes)
        inner = F.when(last, left).otherwise(F.rtrim(left, F.lit(SLOT)))
        return F.array(
            _span(i, own), _span(i + F.length(own) - F.length(left), inner)
        )

    def _span(start: Column, text: Column) -> Column:
        return F.struct(
            start.alias("start"), F.length(text).alias("size"), (~F.contains(text, F.lit(SLOT))).alias("copy")
        )

    every = F.array_distinct(F.flatten(F.transform(first, run)))
    return F.filter(every, lambda s: s["size"] >= least)


def _tokens(rows: DataFrame, text: str, *keep: Column) -> DataFrame:
    raw = rows.select(*keep, raw_form(F.col(text)).alias("raw"))
    return raw.select("*", template_form(F.col("raw")).alias("template"))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``doc_id, text_key, item_id, run, matched, same_slots``: leaked items of each document.

    Items and documents are turned into templates, word by word.  All windows of WINDOW words
    of an item, and those at every STRIDE-th word of a document, meet in a join on their hash;
    any shared run of MIN_RUN template words holds such a pair.  Windows of raw words meet as
    well, so a copy is found whatever words look like names in it; template windows of an item
    without any literal word are left out, since every table of numbers would meet them (a run
    of them is found as a copy or by its other windows).  Each pair gives an alignment,
    which is compared in full, word by word: a word is equal if its template or its raw word is.
    A run of equal words counts if it has MIN_RUN words (or the whole item) and is a word-for-word
    copy, or if MIN_LITERALS words of the alignment (all, for an item with fewer) are equal and no
    placeholders with other raw words, and the run's slots are consistent: an item's value always
    stands for one value of the document.  Slots with other values at an end of a run that is no
    end of the item may belong to the text around a partial copy, so the run is judged without
    them too.  ``run`` is the length of the longest run that counts, ``matched`` the share of the
    item's words that are equal; ``same_slots`` tells plain copies from re-parameterised ones.

    Items of fewer than MIN_RUN words are matched whole, by windows of their own length at
    every word.  Null texts, and items without words, match nothing; rows with the same id and
    text are one document; null ids are kept; the best alignment is given for each document and
    item.  Empty tables give no rows.
    """
    spark = docs.sparkSession
    work = shared_folder(spark)
    items = _tokens(benchmark, item_text, F.col(item_id).alias("item_id")).distinct()
    items = items.select("item_id", _words("raw").alias("raw"), _words("template").alias("words"))
    items = items.withColumn("plain", _unmarked("raw"))
    items = stored(items.where(F.size("words") > 0), f"{work}/items")
    short = [
        r[0]
        for r in items.where(F.size("words") < MIN_RUN).select(F.size("words")).distinct().collect()
    ]
    size = F.size("words")
    def probes(words: Column) -> Column:
        own = F.lit(None).cast("array<struct<pos:int,h:bigint>>")
        for n in short:  # at most MIN_RUN - 1 lengths
            own = F.when(size == n, _windows(words, n, n)).otherwise(own)
        return F.coalesce(own, _windows(words, WINDOW, 1))

    span = F.when(size < MIN_RUN, size).otherwise(WINDOW)
    worded = F.filter(
        probes(F.col("words")),
        lambda w: F.exists(F.slice("words", w["pos"] + 1, span), lambda x: ~x.isin(NAME, NUMBER, UNIT)),
    )
    both = F.array_distinct(F.concat(worded, probes(F.col("plain"))))
    sought = items.select("item_id", F.explode(both).alias("w")).select(
        "item_id", F.col("w.pos").alias("item_pos"), F.col("w.h").alias("h")
    )
    sought = stored(sought, f"{work}/sought")

    key = [
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(text), F.length(F.col(text))).alias("text_key"),
    ]
    forms = _tokens(docs, text, *key)
    ways = [(WINDOW, STRIDE), *((n, 1) for n in sorted(short))]
    words = forms.select(
        "doc_id",
        "text_key",
        F.explode(F.array("template", F.translate("raw", NAME, ""))).alias("form"),
    ).select("doc_id", "text_key", _words(F.col("form")).alias("words"))
    windows = F.concat(*(_windows(F.col("words"), n, step) for n, step in ways))
    cut = words.select("doc_id", "text_key", F.explode(windows).alias("w")).select(
        "doc_id", "text_key", F.col("w.pos").alias("pos"), F.col("w.h").alias("h")
    )
    small = sought.count() <= BROADCAST_WINDOWS
    met = cut.join(F.broadcast(sought) if small else sought, "h")
    alignments = met.select(
        "doc_id", "text_key", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")
    ).distinct()
    alignments = stored(alignments, f"{work}/alignments")

    found = alignments.select("doc_id", "text_key").distinct()
    same_doc = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
    # whole texts of the met documents only, so that no other text is put in form a second time
    texts = docs.select(*key, F.col(text).alias("text"))
    texts = texts.join(found, same_doc(texts, found), "left_semi").dropDuplicates(["doc_id", "text_key"])
    texts = stored(texts, f"{work}/met")
    body = _tokens(texts, "text", F.col("doc_id"), F.col("text_key")).select(
        "doc_id",
        "text_key",
        _words(F.col("raw")).alias("doc_raw"),
        _words(F.col("template")).alias("doc_words"),
    )
    both = (
        alignments.join(items, "item_id")
        .join(body.withColumnsRenamed({"doc_id": "d", "text_key": "k"}),
              F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")))
        .drop("d", "k")
    )
    at = F.sequence(F.lit(0), F.size("words") - 1)
    value = lambda i: F.translate(F.get("raw", i), NAME, "")
    other = lambda i: F.translate(F.get("doc_raw", F.col("shift") + i), NAME, "")
    code = F.transform(
        at,
        lambda i: F.when(value(i) == other(i), COPIED)
        .when(F.get("words", i) == F.get("doc_words", F.col("shift") + i), SLOT)
        .otherwise(APART),
    )
    both = both.withColumn("codes", F.array_join(code, "")).withColumn("n", F.size("words"))
    runs = both.withColumn("spans", _spans(F.col("codes"), F.least(F.lit(MIN_RUN), "n")))

    def slots(s: Column) -> Column:
        inside = F.filter(
            F.sequence(s["start"], s["start"] + s["size"] - 1),
            lambda i: F.get("words", i).isin(NAME, NUMBER, UNIT),
        )
        pairs = F.transform(inside, lambda i: F.struct(value(i).alias("x"), other(i).alias("y")))
        return F.array_distinct(pairs)

    literals = F.length(F.translate("codes", APART + SLOT, ""))
    equal = F.length(F.translate("codes", APART, ""))
    judged = runs.select(
        "doc_id",
        "text_key",
        "item_id",
        (equal / F.col("n")).alias("matched"),
        (literals >= F.least(F.lit(MIN_LITERALS), "n")).alias("worded"),
        F.explode(
            F.transform(
                "spans",
                lambda s: F.struct(s["size"].alias("run"), s["copy"].alias("copy"), slots(s).alias("pairs")),
            )
        ).alias("span"),
    ).select("*", "span.*")
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["x"])))
    kept = judged.where(F.col("copy") | (F.col("worded") & consistent))
    best = F.struct("run", "matched", F.col("copy").alias("same_slots"))
    return (
        kept.groupBy("doc_id", "text_key", "item_id")
        .agg(F.max(best).alias("best"))
        .select("doc_id", "text_key", "item_id", "best.*")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, with all its columns, without the documents that hold a leaked item."""
    leaks = find_leaks(docs, benchmark).select("doc_id", "text_key").distinct()
    d, k = docs.alias("d"), leaks.alias("k")
    text = F.col("d.text")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (
        F.xxhash64(text, F.length(text)) == F.col("k.text_key")
    )
    return d.join(k, same, "left_anti")
