"""Substring deduplication by sliding sentence spans.

A sentence ends at a word that ends in . ! or ? and at a line break.  Sentences of more than CUT words also end
after each word whose hash is the least of some CUT words in a row, so none is longer than CUT words, and
passages hold the same ends wherever they are pasted.  Each sentence starts a span: the shortest run of at
least `sentences` sentences and `words` words.  With the default numbers every repeat of 48 words or more (line breaks alike) holds
a whole span, punctuated or not: an end that both places have lies among its first 14 words, the span ends
within 27 more, and 7 at the end may be cut differently.  Spans are hashed and joined globally; of a span
that occurs more than once all places but the first (least doc_id, then row, then position) are removed, whole
sentences with the white space after them.  Later places within a text need no join: they are found in the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haplospark.llm.common import binary_parts, bucketed, keyed_texts, mix64, slices, small_batches, staged, unstage
from haplospark.llm.minhash import _LOWER, _SPACE, BYTES, _blocks
from haplospark.llm.suffix_dedup import Hasher

CUT = 8  # words in a sentence at most; a power of two


def _least(w: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which words have the least hash of some CUT words in a row within their text, all of equal ones."""
    at = np.arange(len(w)) + of + 1
    x = np.zeros(at[-1] + CUT, np.uint64)  # a zero between texts: no run over it has a least word
    x[at] = w
    low, step = x, 1
    while step < CUT:
        low, step = np.minimum(low[:-step], low[step:]), 2 * step
    best, step = np.concatenate([np.zeros(CUT - 1, np.uint64), low, np.zeros(CUT - 1, np.uint64)]), 1
    while step < CUT:
        best, step = np.maximum(best[:-step], best[step:]), 2 * step
    return best[at] == w


def sentences_of(texts: list[memoryview], hasher: Hasher) -> tuple[np.ndarray, ...]:
    """Of all sentences in order: text number, begin and end byte within the text, words, hash.

    The first sentence of a text begins at its first byte, each ends where the next begins.
    """
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(size + 1) - size - 1
    word = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    text = _LOWER[raw]
    w = hasher.of(hasher.prefix(text), begin, end)
    of = np.searchsorted(starts, begin, side="right") - 1
    lines = np.cumsum(raw == 10)
    stop = np.isin(raw[end - 1], np.frombuffer(b".!?", np.uint8))
    stop[:-1] |= (lines[begin[1:]] != lines[end[:-1] - 1]) | (of[1:] != of[:-1])
    stop[-1] = True
    size_of = np.diff(np.flatnonzero(stop), prepend=-1)
    stop |= np.repeat(size_of > CUT, size_of) & _least(w, of)
    last = np.flatnonzero(stop)
    first = np.concatenate([[0], last[:-1] + 1])
    n = last - first + 1
    place = (np.arange(len(w)) - np.repeat(first, n)).astype(np.uint64)
    h = mix64(np.add.reduceat(mix64(w + place * np.uint64(0x9E3779B97F4A7C15)), first) + n.astype(np.uint64))
    own = of[first]
    at = begin[first] - starts[own]
    new = np.concatenate([[True], own[1:] != own[:-1]])
    at[new] = 0
    stop_at = np.concatenate([at[1:], [0]])
    stop_at[np.concatenate([new[1:], [True]])] = size[own[np.concatenate([new[1:], [True]])]]
    return own, at, stop_at, n, h


def spans_of(own: np.ndarray, n: np.ndarray, h: np.ndarray, sentences: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, sentences, hash) of each span: the shortest run from a sentence that is long enough."""
    total = np.concatenate([[0], np.cumsum(n)])
    stop = np.maximum(np.arange(len(n)) + sentences, np.searchsorted(total, total[:-1] + words))
    inside = stop <= np.searchsorted(own, own, side="right")
    first = np.flatnonzero(inside)
    count = stop[first] - first
    out = np.zeros(len(first), np.uint64)
    for j in range(int(count.max(initial=0))):
        more = count > j
        out[more] = mix64(out[more] * np.uint64(3) + h[first[more] + j])
    return first, count, out


def again(own: np.ndarray, first: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Which spans have an earlier place in their own text."""
    order = np.argsort(span, kind="stable")
    of, out = own[first[order]], np.zeros(len(span), bool)
    out[order[1:]] = (span[order[1:]] == span[order[:-1]]) & (of[1:] == of[:-1])
    return out


def _span_rows(sentences: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(BYTES)
        for rows, texts in _blocks(batches):
            own, _, _, n, h = sentences_of(texts, hasher)
            first, _, span = spans_of(own, n, h, sentences, words)
            new = ~again(own, first, span)
            first, span = first[new], span[new]
            if len(first):
                take = pa.array(own[first])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(span.view(np.int64)), rows.column("doc_id").take(take), rows.column("row_id").take(take)], ["span", "doc_id", "row_id"]
                )

    return run


def _cut(sentences: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(BYTES)
        for rows, texts in _blocks(batches):
            own, begin, end, n, h = sentences_of(texts, hasher)
            first, count, span = spans_of(own, n, h, sentences, words)
            later, of = again(own, first, span), own[first]
            for i, cuts in enumerate(rows.column("cuts")):
                if cuts.is_valid:
                    mine = slice(*np.searchsorted(of, [i, i + 1]))
                    later[mine] |= np.isin(span[mine].view(np.int64), cuts.values.to_numpy())
            change = np.zeros(len(own) + 1, np.int64)
            np.add.at(change, first[later], 1)
            np.add.at(change, (first + count)[later], -1)
            at = np.searchsorted(own, np.arange(len(texts) + 1))
            removed = np.cumsum(change)[:-1] > 0
            kept, n_removed = [], []
            for i, text in enumerate(texts):
                b, e, gone = (x[at[i] : at[i + 1]] for x in (begin, end, removed))
                n_removed.append(int(gone.sum()))
                kept.append(b"".join(text[x:y] for x, y, g in zip(b.tolist(), e.tolist(), gone.tolist()) if not g) if gone.any() else bytes(text))
            carried = [c for c in rows.schema.names if c not in ("text", "cuts")]
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in carried), pa.array(np.diff(at)), pa.array(n_removed, pa.int64()), pa.array([k.decode() for k in kept], pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
                [*carried, "n_sentences", "n_removed", "kept", "kept_sha256"],
            )

    return run


def sentence_span_dedup(docs: DataFrame, sentences: int = 3, words: int = 20, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Remove sentences that a repeated span covers, but for the span's first occurrence.

    Returns a row per input row: row_id, doc_id, rest (the other columns as one struct, if there are any),
    n_sentences, n_removed, kept (text), kept_sha256.  A null text is empty; texts with fewer sentences or words
    than a span lose nothing; null ids come first in the order, and rows with equal ids follow the order of
    the input; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    texts = bucketed(keyed_texts(docs, text_col, id_col, rest=True), "row_id", "texts")
    id_type = texts.schema["doc_id"].dataType.simpleString()
    spans = staged(texts.select("row_id", "doc_id", "text").mapInArrow(_span_rows(sentences, words), f"span long, doc_id {id_type}, row_id long"), "spans")
    twice = staged(spans.groupBy("span").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("span"), "twice")
    found = staged(spans.join(twice.hint("shuffle_merge"), "span"), "found")
    unstage(spans, twice)
    first = staged(found.groupBy("span").agg(F.min(F.struct("doc_id", "row_id")).alias("first")), "first")
    later = staged(found.join(first.hint("shuffle_merge"), "span").where("row_id <> first.row_id").select("row_id", "span"), "later")
    unstage(found, first)
    cuts = later.groupBy("row_id").agg(F.collect_list("span").alias("cuts")).hint("shuffle_merge")
    schema = T.StructType([f for f in texts.schema if f.name != "text"]).add("n_sentences", "long").add("n_removed", "long").add("kept", "string").add("kept_sha256", "string")
    return texts.join(cuts, "row_id", "left").mapInArrow(_cut(sentences, words), schema)
