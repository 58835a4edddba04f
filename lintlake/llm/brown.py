"""LM scoring: a class-based bigram model with classes from exchange clustering."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.sources.storage import discard, shared_folder, stored

END = b" "  # not a word: words hold no blanks
CLASSES = 32
OWN_SHARE = 1 << 14  # words with at least 1/OWN_SHARE of the tokens are units of their own
POOLS = 512  # the other words are pooled by their ending
MIN_COUNT = 5  # words with as many tokens are moved by their own contexts as well
ROUNDS = 6
WORD_ROUNDS = 3  # passes over the texts in which these words move
SHARE_WORDS = 1 << 14  # words of a share, which moves its words by itself; 16 bits at most
SHARE_STEPS = 64  # how often a share brings its class counts up to date
MIN_GAIN = 3.5  # nats a word must gain to move: log of the number of classes
RUN = 1_000_000  # tokens counted at once
ADD = 0.1
BLOCK_CHARS = 16 << 20
STRENGTH = 5.0  # pseudo-counts of the class shares in a class's transitions


def pool_of(word: bytes) -> int:
    """The pool of a word that is no unit of its own: by its last three bytes."""
    return zlib.crc32(word[-3:]) % POOLS


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, then one end."""
    words = (text or "").encode().lower().split()
    words.append(END)
    return words


def _coded(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Texts as places in the word list of their block, and the word lists, stored.

    A block is a run of about BLOCK_CHARS of a partition.  A text is a row ``block, doc_id,
    held_out, ids`` (32-bit places, the end's among them); a word of a block is a row ``block,
    place, word, n`` with ``n`` of them in training texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        places: defaultdict[bytes, int] = defaultdict()
        places.default_factory = places.__len__
        size, trained = 0, []

        def words_of_block():
            n = np.bincount(np.concatenate([np.zeros(0, np.int32), *trained]), minlength=len(places))
            words = list(places)
            for i in range(0, len(words), 20_000):
                some = words[i : i + 20_000]
                yield rows(
                    len(some),
                    place=pa.array(np.arange(i, i + len(some), dtype=np.int32)),
                    word=pa.array(some, type=pa.binary()),
                    n=pa.array(n[i : i + len(some)].astype(np.int64)),
                )

        def rows(count: int, **given: pa.Array) -> pa.RecordBatch:
            given["block"] = pa.array(np.full(count, (part << 24) + block))
            columns = [given.get(f.name, pa.nulls(count, f.type)) for f in _CODED]
            return pa.RecordBatch.from_arrays(columns, schema=_CODED)

        for batch in batches:
            ids, first = [], 0
            for k in range(len(batch)):
                body = batch.column(2)[k].as_py()
                at = np.array([places[w] for w in tokens_of(body)], dtype=np.int32)
                ids.append(at.tobytes())
                if not batch.column(1)[k].as_py():
                    trained.append(at)
                size += len(body)
                if size >= BLOCK_CHARS or k == len(batch) - 1:
                    yield rows(
                        len(ids),
                        doc_id=batch.column(0).slice(first, len(ids)),
                        held_out=batch.column(1).slice(first, len(ids)),
                        ids=pa.array(ids, type=pa.binary()),
                    )
                    ids, first = [], k + 1
                if size >= BLOCK_CHARS:
                    yield from words_of_block()
                    places.clear()
                    block, size, trained = block + 1, 0, []
        if places:
            yield from words_of_block()

    key = F.col(id_col).cast("string")
    held = F.coalesce(F.crc32(key) % 10 == 0, F.lit(False))
    texts = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        held.alias("held_out"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    return texts.mapInArrow(
        run,
        "block bigint, doc_id bigint, held_out boolean, ids binary, place int, word binary, n bigint",
    )


_CODED = pa.schema(
    [
        ("block", pa.int64()),
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("ids", pa.binary()),
        ("place", pa.int32()),
        ("word", pa.binary()),
        ("n", pa.int64()),
    ]
)


def _with_units(words: DataFrame, own) -> DataFrame:
    """``part, seq, unit, c, at`` of words: own units first, then the pools.

    Words that move by themselves are numbered by ``seq`` in their ``part``; others have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, part, given = own.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            unit = [units[w] if w in units else len(units) + pool_of(w) for w in names]
            moves = (np.array(unit) >= len(units)) & (batch.column(1).to_numpy() >= MIN_COUNT)
            seq = given + np.cumsum(moves) - 1
            given += int(moves.sum())
            columns = [
                pa.array(np.full(len(names), part, dtype=np.int32)),
                pa.array(seq, type=pa.int64(), mask=~moves),
                pa.array(unit, type=pa.int32()),
                *batch.columns[1:],
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "seq", "unit", "c", "at"])

    schema = "part int, seq bigint, unit int, c bigint, at array<struct<block:bigint,place:int>>"
    return words.select("word", "c", "at").mapInArrow(run, schema)


def _numbered(units: DataFrame, n_units: int) -> tuple[DataFrame, np.ndarray]:
    """``unit, c, at, code`` of words, and the unit of each code.

    A code is the word's unit, or ``n_units`` and more for a word that moves by itself.  The
    driver gets two bytes for each of these.
    """
    counts = units.where("seq is not null").groupBy("part").count().collect()  # a row per task
    firsts, n = {}, n_units
    for part, count in sorted((r["part"], r["count"]) for r in counts):
        firsts[part], n = n, n + count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = np.array([firsts.get(p, 0) for p in batch.column(0).to_pylist()], dtype=np.int64)
            seq = batch.column(1).fill_null(-1).to_numpy()
            code = np.where(seq < 0, batch.column(2).to_numpy(), first + seq)
            columns = [*batch.columns[2:], pa.array(code.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["unit", "c", "at", "code"])

    schema = "unit int, c bigint, at array<struct<block:bigint,place:int>>, code int"
    coded = units.mapInArrow(run, schema)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                code, unit = batch.column(1).to_numpy(), batch.column(0).to_numpy()
                order = np.argsort(code)
                for some in np.split(order, np.flatnonzero(np.diff(code[order]) != 1) + 1):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(code[some[:1]]),
                            pa.array([unit[some].astype(np.uint16).tobytes()], type=pa.binary()),
                        ],
                        names=["first", "units"],
                    )

    unit_of = np.concatenate((np.arange(n_units), np.zeros(n - n_units, int))).astype(np.uint16)
    listed = coded.where(F.col("code") >= n_units).select("unit", "code")
    for first, of in listed.mapInArrow(pooled, "first int, units binary").collect():
        of = np.frombuffer(of, np.uint16)
        unit_of[first : first + len(of)] = of
    return coded, unit_of


def _by_place(table: pa.Table, column: str, kind: type) -> np.ndarray:
    """A column of a block's words in the order of their places."""
    place = table.column("place").to_numpy()
    out = np.zeros(len(place), dtype=kind)
    out[place] = table.column(column).to_numpy()
    return out


def _recoded(texts: DataFrame, words: DataFrame, base_mass: float) -> DataFrame:
    """Texts with their words' codes, and what of their scores does not depend on classes."""

    def run(key: tuple, texts: pa.Table, words: pa.Table) -> pa.Table:
        code, count = _by_place(words, "code", np.int32), _by_place(words, "c", np.int64)
        logs = np.log10(count + ADD)
        n, known, base, word, codes = [], [], [], [], []
        for ids in texts.column("ids"):
            at = np.frombuffer(ids.as_buffer(), dtype=np.int32)
            n.append(len(at))
            known.append(int(np.count_nonzero(count[at])))
            base.append(float((logs[at] - base_mass).sum()))
            word.append(float(logs[at].sum()))
            codes.append(code[at].tobytes())
        return pa.table(
            {
                "doc_id": texts.column("doc_id"),
                "held_out": texts.column("held_out"),
                "n_tokens": pa.array(n, type=pa.int64()),
                "n_known": pa.array(known, type=pa.int64()),
                "base_score": pa.array(base, type=pa.float64()),
                "logs": pa.array(word, type=pa.float64()),
                "codes": pa.array(codes, type=pa.binary()),
            }
        )

    return (
        texts.groupBy("block")
        .cogroup(words.groupBy("block"))
        .applyInArrow(
            run,
            "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint,"
            " base_score double, logs double, codes binary",
        )
    )


def _runs(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[np.ndarray]:
    """Codes of texts in runs of about RUN, each begun after an end."""
    waiting, size = [], 0
    for batch in batches:
        for codes in batch.column(0):
            waiting.append(np.frombuffer(codes.as_buffer(), dtype=np.int32))
            size += len(waiting[-1])
            if size > RUN:
                yield np.concatenate([np.array([end], np.int32), *waiting])
                waiting, size = [], 0
    if waiting:
        yield np.concatenate([np.array([end], np.int32), *waiting])


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]), return_inverse=True)
    n = np.concatenate([np.zeros(0, np.int64), *counts])
    return code, np.bincount(at, n, len(code)).astype(np.int64)


def _unit_pairs(trained: DataFrame, unit_of: np.ndarray, n_units: int, end: int) -> DataFrame:
    """``a, b, n``: how often unit b follows unit a in training texts; texts begin after an end."""
    shared = trained.sparkSession.sparkContext.broadcast(unit_of)

    def rows(codes: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        code, n = _summed(codes, counts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array((code // n_units).astype(np.int32)),
                pa.array((code % n_units).astype(np.int32)),
                pa.array(n),
            ],
            names=["a", "b", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = [], []
        for run_ in _runs(batches, end):
            u = shared.value[run_].astype(np.int64)
            code, n = np.unique(u[:-1] * n_units + u[1:], return_counts=True)
            codes.append(code)
            counts.append(n)
            if sum(map(len, codes)) > 2 * RUN:
                yield rows(codes, counts)
                codes, counts = [], []
        yield rows(codes, counts)

    pairs = trained.select("codes").mapInArrow(run, "a int, b int, n bigint")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _transitions(trained: DataFrame, shared, end: int) -> np.ndarray:
    """How often each class follows each in the training texts."""
    width = CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width, dtype=np.int64)
        for run_ in _runs(batches, end):
            k = shared.value[run_].astype(np.int64)
            total += np.bincount(k[:-1] * width + k[1:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    cells = trained.select("codes").mapInArrow(run, "cell bigint, n bigint")
    table = np.zeros(width * width)
    for cell, n in cells.groupBy("cell").agg(F.sum("n")).collect():  # classes x classes
        table[cell] = n
    return table.reshape(width, width)


def move_share(
    after: np.ndarray, before: np.ndarray, home: np.ndarray, table: np.ndarray, shares: int
) -> np.ndarray:
    """New classes of a share's words, by the classes after and before each.

    Words are taken from the most frequent on, a SHARE_STEPS-th of them at once.  Each goes to
    the class where the likelihood of its own tokens is highest, if that gains MIN_GAIN.  All
    shares move at once and by themselves; a share is a random part of the words, so it counts
    its moves ``shares`` times in its class counts, for what the other shares move, and words
    don't crowd into the classes that are best before the round.
    """
    table, new = table.copy(), home.copy()
    order = np.argsort(-after.sum(1), kind="stable")
    step = max(1, -(-len(order) // SHARE_STEPS))
    for s in range(0, len(order), step):
        k = order[s : s + step]
        r, l, h = after[k], before[k], home[k]
        logs = np.log(table + 0.5)
        out, into = np.log(table.sum(1) + 1), np.log(table.sum(0) + 1)
        gain = r @ logs.T + l @ logs - np.outer(r.sum(1), out) - np.outer(l.sum(1), into)
        gain = gain[:, :CLASSES]
        best, each = gain.argmax(1), np.arange(len(k))
        goes = gain[each, best] - gain[each, h] > MIN_GAIN
        new[k[goes]] = best[goes]
        for d in np.unique(np.concatenate((h[goes], best[goes]))):
            come, leave = goes & (best == d), goes & (h == d)
            table[d] += shares * (r[come].sum(0) - r[leave].sum(0))
            table[:, d] += shares * (l[come].sum(0) - l[leave].sum(0))
        np.maximum(table, 0, out=table)
    return new


def _moved(trained: DataFrame, classes: np.ndarray, n_units: int, end: int) -> np.ndarray:
    """Classes by code after a round in which the words from code ``n_units`` on moved.

    Each token of such a word is sent to the word's share with the classes beside it, about two
    bytes; a share's counts are words x classes.  A byte for each word comes back.
    """
    shared = trained.sparkSession.sparkContext.broadcast(classes)
    table = _transitions(trained, shared, end)
    width, n_words = CLASSES + 1, len(classes) - n_units
    shares = -(-n_words // SHARE_WORDS)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run_ in _runs(batches, end):
            k = shared.value[run_]
            at = np.flatnonzero(run_ >= n_units)  # never the first; each text ends with an end
            word = run_[at] - n_units
            order = np.lexsort((word, word % shares))
            at, word = at[order], word[order]
            for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(word % shares)) + 1):
                if not len(some):
                    continue
                mine, number = at[some], word[some[0]] % shares
                steps = np.diff(word[some] // shares, prepend=0).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], type=pa.int32()),
                        pa.array([steps.tobytes()], type=pa.binary()),
                        pa.array([k[mine + 1].tobytes()], type=pa.binary()),
                        pa.array([k[mine - 1].tobytes()], type=pa.binary()),
                    ],
                    names=["share", "words", "after", "before"],
                )

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, words, after, before in zip(*(c.to_pylist() for c in batch.columns)):
                size = -(-(n_words - number) // shares)
                total = sums.setdefault(number, np.zeros((2, size * width)))
                at = np.cumsum(np.frombuffer(words, np.uint16), dtype=np.int64) * width
                for side, beside in enumerate((after, before)):
                    cells = at + np.frombuffer(beside, np.uint8)
                    total[side] += np.bincount(cells, minlength=size * width)
        for number in sorted(sums):
            after, before = sums.pop(number).reshape(2, -1, width)
            home = shared.value[n_units + number :: shares].astype(np.int64)
            new = move_share(after, before, home, table, shares).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], type=pa.int32()), pa.array([new.tobytes()], type=pa.binary())],
                names=["share", "classes"],
            )

    sent = trained.select("codes").mapInArrow(
        contexts, "share int, words binary, after binary, before binary"
    )
    found = sent.repartition(shares, "share").mapInArrow(move, "share int, classes binary")
    new = classes.copy()
    for number, of in found.collect():
        new[n_units + number :: shares] = np.frombuffer(of, np.uint8)
    return new


def _mass(words: DataFrame, shared) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and trained words of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, types = np.zeros(CLASSES + 1, np.int64), np.zeros(CLASSES + 1, np.int64)
        for batch in batches:
            k, c = shared.value[batch.column(0).to_numpy()], batch.column(1).to_numpy()
            tokens += np.bincount(k, c, len(tokens)).astype(np.int64)
            types += np.bincount(k, minlength=len(types))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(tokens))), pa.array(tokens), pa.array(types)], names=["k", "c", "n"]
        )

    sums = words.where("c > 0").select("code", "c").mapInArrow(run, "k bigint, c bigint, n bigint")
    tokens, types = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for k, c, n in sums.groupBy("k").agg(F.sum("c"), F.sum("n")).collect():  # a row per class
        tokens[k], types[k] = c, n
    return tokens, types


def _contexts(pairs: DataFrame, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each unit before and after each class: units x classes, of bounded size."""
    spark = pairs.sparkSession
    shared = spark.sparkContext.broadcast(classes.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, width = shared.value, CLASSES + 1
        total = np.zeros((2, len(of) * width), dtype=np.int64)
        for batch in batches:
            a, b, n = (c.to_numpy() for c in batch.columns)
            total[0] += np.bincount(a * width + of[b], n, total.shape[1]).astype(np.int64)
            total[1] += np.bincount(b * width + of[a], n, total.shape[1]).astype(np.int64)
        for side in (0, 1):
            at = np.flatnonzero(total[side])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), side)), pa.array(at), pa.array(total[side][at])],
                names=["side", "cell", "n"],
            )

    cells = pairs.mapInArrow(run, "side bigint, cell bigint, n bigint")
    out = np.zeros((2, len(classes) * (CLASSES + 1)))
    for side, cell, n in cells.groupBy("side", "cell").agg(F.sum("n")).toArrow().to_pandas().values:
        out[side, cell] = n
    shape = (len(classes), CLASSES + 1)
    return out[0].reshape(shape), out[1].reshape(shape)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: DataFrame, n_units: int, end: int) -> np.ndarray:
    """Class of each unit: exchange clustering of the class bigrams' likelihood.

    Each round counts the classes around every unit in one pass over the unit pairs; then the
    units are visited from the most frequent on and moved to the class where the likelihood
    ``sum n(c,d) log n(c,d) - sum n(c) log n(c) - sum n(d) log n(d)`` gains most, with the
    class counts brought up to date after each move.  The end is a class of its own.
    """
    totals = np.zeros(n_units)
    for unit, n in pairs.groupBy("a").agg(F.sum("n")).collect():  # a row per unit: bounded
        totals[unit] = n
    order = np.argsort(-totals, kind="stable")
    classes = np.empty(n_units, dtype=np.int64)
    classes[order] = np.arange(n_units) % CLASSES
    classes[end] = CLASSES
    width = CLASSES + 1
    for _ in range(ROUNDS):
        after, before = _contexts(pairs, classes)
        table = np.zeros((width, width))
        np.add.at(table, classes, after)
        moved = 0
        for unit in order:
            if unit == end or totals[unit] == 0:
                continue
            right, left, home = after[unit], before[unit], classes[unit]
            table[home] -= right
            table[:, home] -= left
            np.maximum(table, 0, out=table)
            rows = _xlogx(table + right).sum(1) - _xlogx(table).sum(1)
            columns = _xlogx(table + left[:, None]).sum(0) - _xlogx(table).sum(0)
            out, into = table.sum(1), table.sum(0)
            loss = _xlogx(out + right.sum()) - _xlogx(out) + _xlogx(into + left.sum()) - _xlogx(into)
            gain = (rows + columns - loss)[:CLASSES]
            best = int(np.argmax(gain))
            if gain[best] <= gain[home] + 1e-9 if home < CLASSES else False:
                best = home
            table[best] += right
            table[:, best] += left
            moved += best != home
            classes[unit] = best
        if not moved:
            break
    return classes


def _log_model(table: np.ndarray, tokens: np.ndarray, types: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the class transitions, and each class's log10 emission total.

    A word has ``(c + ADD) / (N_class + ADD * (V_class + 1))`` in its class, an unseen word the
    share of c = 0; transitions are smoothed with the classes' own shares.
    """
    mass = tokens + ADD * (types + 1)
    share = mass / mass.sum()
    rows = table.sum(1, keepdims=True)
    return np.log10((table + STRENGTH * share) / (rows + STRENGTH)), np.log10(mass)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row.

    The model learns from rows whose ``crc32(id as text) mod 10`` is not 0; a null id trains.
    All counts cover the whole training corpus:

    * texts become places in the word list of their block; a word's total and code go back
      only to the blocks that hold the word, once, so no text is cut into words twice;
    * units: words with 1/OWN_SHARE of all tokens or more, which are OWN_SHARE at most, and
      POOLS pools of the others by their ending, so unseen words have a class as well;
    * unit bigrams, from which ``exchange`` makes the classes of the units;
    * every other word with MIN_COUNT tokens or more then moves from its pool's class by its own
      contexts, in WORD_ROUNDS passes over the texts (see ``move_share``).  Driver and tasks
      hold three bytes for each of these words, and no words or counts of the vocabulary.

    The score is the sum of ``log10 p(class | class before) + log10 p(word | class)``; the base
    score is the unigram one.  A null or empty text is one end token.  Repeated rows are scored
    each, an empty table gives no rows, other columns are not read.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    coded = stored(_coded(docs, id_col, text), f"{folder}/coded")
    texts = coded.where("ids is not null").select("block", "doc_id", "held_out", "ids")
    words = coded.where("word is not null").groupBy("word").agg(
        F.sum("n").alias("c"), F.collect_list(F.struct("block", "place")).alias("at")
    )
    words = stored(words, f"{folder}/words")
    trained = words.where("c > 0")
    n_tokens, n_types = trained.agg(F.sum("c"), F.count("*")).first()
    n_tokens = n_tokens or 0
    frequent = trained.where(F.col("c") * OWN_SHARE >= n_tokens).select("word").collect()
    names = sorted({END, *(bytes(r.word) for r in frequent)})
    own = {word: unit for unit, word in enumerate(names)}
    n_units, end = len(own) + POOLS, own[END]
    # OWN_SHARE + 1 words at most
    units = _with_units(words, spark.sparkContext.broadcast(own))
    units = stored(units, f"{folder}/units")
    discard(spark, f"{folder}/words")
    units, unit_of = _numbered(units, n_units)
    base_mass = np.log10(n_tokens + ADD * (n_types + 1))
    back = units.select("code", "c", F.explode("at").alias("at")).select("at.*", "code", "c")
    texts = stored(_recoded(texts, back, base_mass), f"{folder}/texts")
    discard(spark, f"{folder}/coded")
    trained = texts.where("not held_out").select("codes")
    pairs = stored(_unit_pairs(trained, unit_of, n_units, end), f"{folder}/pairs")
    classes = exchange(pairs, n_units, end).astype(np.uint8)[unit_of]
    for _ in range(WORD_ROUNDS if len(unit_of) > n_units else 0):
        classes = _moved(trained, classes, n_units, end)

    shared = spark.sparkContext.broadcast(classes)
    steps, mass = _log_model(_transitions(trained, shared, end), *_mass(units, shared))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own_score = []
            for codes, logs in zip(batch.column("codes"), batch.column("logs")):
                k = shared.value[np.frombuffer(codes.as_buffer(), dtype=np.int32)]
                before = np.concatenate((shared.value[end : end + 1], k[:-1]))
                own_score.append(logs.as_py() + float((steps[before, k] - mass[k]).sum()))
            columns = [batch.column(x) for x in ("doc_id", "held_out", "n_tokens", "n_known")]
            columns.append(pa.array([n_tokens] * len(batch), type=pa.int64()))
            columns += [batch.column("base_score"), pa.array(own_score, type=pa.float64())]
            yield pa.RecordBatch.from_arrays(
                columns,
                names=[
                    "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
                ],
            )

    return texts.mapInArrow(
        score,
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint,"
        " train_tokens bigint, base_score double, score double",
    )
