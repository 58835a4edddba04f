"""Toxicity: subword-bag embeddings, averaged over a window, under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lintlake.llm.spans import slices

BUCKETS = 1 << 17
DIM = 8
SPAN, STEP = 16, 8
ROWS_PER_LABEL = {0: 2000, 1: 1000}
WINDOWS_PER_ROW = 8
EPOCHS = 40
MIN_DOCS = 4
TOXIC_WEIGHT = 0.2
FULL_SAMPLE = 200_000  # words
RATE = 0.1
DAMPING = 0.03  # keeps seldom-seen subwords from steps as long as common ones get
CACHE = 1 << 17


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of the words' byte 3- to 5-grams with word marks, and their owners."""
    flat = np.frombuffer(b"".join(b"<" + w + b">\n" for w in words), dtype=np.uint8)
    mark = (flat == 10).astype(np.int64)
    owner = np.cumsum(mark) - mark
    breaks = np.concatenate(([0], np.cumsum(mark)))
    ids, owners = [], []
    for n in (3, 4, 5):
        count = len(flat) - n + 1
        if count <= 0:
            continue
        h = np.full(count, n, dtype=np.uint64)
        for i in range(n):
            h = (h * np.uint64(1000003)) ^ flat[i : i + count].astype(np.uint64)
        h ^= h >> np.uint64(17)
        whole = breaks[n : n + count] == breaks[:count]
        ids.append(h[whole] % np.uint64(BUCKETS))
        owners.append(owner[:count][whole])
    return np.concatenate(ids).astype(np.int64), np.concatenate(owners)


class GroupSum:
    """Sums of ``values[source]`` by ``group``, with the order worked out once."""

    def __init__(self, group: np.ndarray, source: np.ndarray):
        order = np.argsort(group, kind="stable")
        self.source = source[order]
        self.groups, self.first = np.unique(group[order], return_index=True)

    def __call__(self, values: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, values.shape[1]), dtype=values.dtype)
        if len(self.first):
            out[self.groups] = np.add.reduceat(values[self.source], self.first, axis=0)
        return out


def window_starts(n: int) -> np.ndarray:
    """Starts of windows of SPAN words every STEP words that cover n words."""
    if n <= SPAN:
        return np.zeros(1, dtype=np.int64)
    return np.append(np.arange(0, n - SPAN, STEP), n - SPAN)


class Scorer:
    """Window logits by a word table that is made on demand; ``weights`` has one per bucket."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known = {}
        new = list({w for w in words if w not in self.known})
        if new:
            ids, owner = subwords(new)
            total = np.bincount(owner, self.weights[ids], len(new))
            mean = total / np.bincount(owner, minlength=len(new))
            self.known.update(zip(new, mean.tolist()))
        return np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))

    def windows(self, words: list[bytes]) -> np.ndarray:
        """The logit of each window; one window without words for an empty text."""
        if not words:
            return np.array([self.bias])
        total = np.concatenate(([0.0], np.cumsum(self.word_scores(words))))
        start = window_starts(len(words))
        size = min(SPAN, len(words))
        return self.bias + (total[start + size] - total[start])


def fit(docs: list[list[list[bytes]]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Scorer:
    """Embeddings and softmax weights trained together on windows grouped by document.

    A document's logit is a soft maximum over its windows, which sharpens as training goes on,
    so the windows that explain a label get the gradient.  TOXIC_WEIGHT of the loss is
    label 1's.
    """
    vocabulary: dict[bytes, int] = {}
    word_ids, window_of, doc_of = [], [], []
    for d, windows in enumerate(docs):
        for window in windows:
            k = len(doc_of)
            doc_of.append(d)
            for w in window:
                word_ids.append(vocabulary.setdefault(w, len(vocabulary)))
            window_of.extend([k] * len(window))
    if not vocabulary or len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.0
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Scorer(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    word_ids, window_of, doc_of = (np.array(x) for x in (word_ids, window_of, doc_of))
    ids, owner = subwords(list(vocabulary))
    per_word = np.bincount(owner)
    seen = np.unique(doc_of[window_of] * len(vocabulary) + word_ids) % len(vocabulary)
    in_docs = np.bincount(ids, np.bincount(seen, minlength=len(vocabulary))[owner], BUCKETS)
    often = in_docs[ids] >= MIN_DOCS
    ids, owner = ids[often], owner[often]
    used, ids = np.unique(ids, return_inverse=True)
    # A small sample gives few updates a pass, so it gets up to five times as many passes.
    epochs = int(epochs * min(5, max(1, FULL_SAMPLE / len(word_ids))))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (len(used), DIM)).astype(np.float32)
    softmax = rng.normal(0, 0.1, (DIM, 2))
    bias = np.zeros(2)
    toxic, clean = max(1, labels.sum()), max(1, (1 - labels).sum())
    weight = np.where(labels == 1, TOXIC_WEIGHT / toxic, (1 - TOXIC_WEIGHT) / clean)
    params = [table, softmax, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]

    to_word, to_bag = GroupSum(owner, ids), GroupSum(window_of, word_ids)
    to_subword, back = GroupSum(ids, owner), GroupSum(word_ids, window_of)
    sizes = np.maximum(per_word, 1).astype(np.float32)[:, None]

    for epoch in range(epochs):
        vectors = to_word(table, len(sizes)) / sizes
        bags = to_bag(vectors, len(doc_of))
        logits = bags @ softmax + bias
        gap = logits[:, 1] - logits[:, 0]
        sharp = 0.25 + 4.0 * epoch / epochs
        top = np.full(len(docs), -np.inf)
        np.maximum.at(top, doc_of, gap)
        share = np.exp(sharp * (gap - top[doc_of]))
        share /= np.bincount(doc_of, share, len(docs))[doc_of]
        z = np.bincount(doc_of, share * gap, len(docs))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        by_window = ((p - labels) * weight)[doc_of] * share
        by_logit = np.stack([-by_window, by_window], axis=1)
        by_bag = (by_logit @ softmax.T).astype(np.float32)
        by_word = back(by_bag, len(sizes)) / sizes
        grads = [to_subword(by_word, len(used)), bags.T @ by_logit, by_logit.sum(0)]
        rate = RATE * min(1, 2 * (1 - epoch / epochs))
        for p_, g, (m, v) in zip(params, grads, moments):
            m *= 0.8
            m += 0.2 * g
            v *= 0.95
            v += 0.05 * g * g
            size = np.sqrt(v)
            p_ -= (rate * m / (size + DAMPING * size.max() + 1e-12)).astype(p_.dtype)
    weights = np.zeros(BUCKETS)
    weights[used] = table @ (softmax[:, 1] - softmax[:, 0])
    return Scorer(weights, float(bias[1] - bias[0]))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most ROWS_PER_LABEL training rows of each label, in an order by hash."""
    marked = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where("id is not null and toxic in (0, 1)")
    marked = marked.where(F.crc32(F.col("id").cast("string")) % 5 != 0)
    marked = marked.groupBy("id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64(F.lit("sample"), "id"), F.col("id")]
    chosen = [
        marked.where(F.col("toxic") == k).orderBy(*order).limit(n) for k, n in ROWS_PER_LABEL.items()
    ]
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text"))
    return texts.join(chosen[0].union(chosen[1]), "id")


def _training_windows(sample: DataFrame, scorer: Scorer | None) -> tuple[list, np.ndarray]:
    """At most WINDOWS_PER_ROW windows of each sampled text: spread evenly, or the top-scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                starts = window_starts(len(words))
                if scorer is None:
                    pick = np.linspace(0, len(starts) - 1, WINDOWS_PER_ROW).astype(int)
                else:
                    pick = np.argsort(-scorer.windows(words))[:WINDOWS_PER_ROW]
                spans = [words[s : s + SPAN] for s in starts[np.unique(pick)]]
                # A word's first 200 bytes hold its n-grams well enough to learn from.
                out.append([b" ".join(w[:200] for w in span) for span in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(out, type=pa.list_(pa.binary()))], ["toxic", "spans"]
            )

    rows = sample.select("text", "toxic").mapInArrow(run, "toxic int, spans array<binary>")
    # Bounded: ROWS_PER_LABEL rows of WINDOWS_PER_ROW windows of SPAN words.
    rows = sorted((r.toxic, [bytes(s) for s in r.spans]) for r in rows.collect())
    one: dict[bytes, bytes] = {}  # one object for each word, however often it occurs
    windows = [[[one.setdefault(w, w) for w in s.split()] for s in spans] for _, spans in rows]
    return windows, np.array([y for y, _ in rows], dtype=float)


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    """The classifier, fitted to rows whose ``crc32(doc_id as text) mod 5`` is not 0.

    The fit uses a bounded sample: ROWS_PER_LABEL rows of each label, WINDOWS_PER_ROW windows
    of each row.  A first fit takes windows spread over the text; a second takes, besides, the
    windows that the first scores highest, wherever they are in the whole text.
    """
    sample = _sample(docs, labels)
    spread, y = _training_windows(sample, None)
    first = fit(spread, y, EPOCHS // 2)
    top, y2 = _training_windows(sample, first)
    return fit([*spread, *top], np.concatenate([y, y2]))


def score(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1 at the text's most toxic window.

    Windows of SPAN words every STEP words cover the whole text.  Null and empty texts get the
    score of a window without words.  All input columns but ``score`` are kept, repeated rows
    are scored each, an empty table gives an empty one.
    """
    weights, bias = scorer.weights.astype(np.float32), scorer.bias
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 4 bytes for each of BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shared.value.astype(np.float64), bias)
        for batch in slices(batches, at):
            texts = batch.column(at).to_pylist()
            z = np.array([own.windows(words_of(x)).max() for x in texts], dtype=np.float64)
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "score"])

    kept = docs.select([c for c in docs.columns if c.lower() != "score"])
    at = kept.columns.index(text)
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType())])
    return kept.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``held_out, score, predicted``; see ``train`` and ``score``.

    ``held_out`` says that ``crc32(doc_id as text) mod 5`` is 0; a null id is not held out.
    Without labels of both kinds every score is the share of label 1.
    """
    scored = score(docs, train(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.withColumns(
        {"held_out": held, "predicted": (F.col("score") >= 0.5).cast("int")}
    )
