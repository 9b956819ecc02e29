"""Best-fit packing of tokenised documents into sequences of a fixed length.

Best-fit decreasing looks at lengths only, so the whole corpus packs from one histogram: how many pieces there
are of each length.  The driver packs that histogram (at most `capacity` numbers, whatever the corpus) with a
segment tree over remaining capacities; a step places a run of equal pieces into a run of equal bins.  Each
piece then finds its place from its length and its number among pieces of that length.  The numbers come
from counts per partition and length, so no task ever holds all pieces of one length.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haplospark.llm.common import binary_parts, slices, small_batches, staged

CACHE_WORDS = 400_000  # tokenised words that a worker keeps, some 70 MB; one batch may go beyond
MARKS = b".,;:!?"
COMBINING = "[\u0300-\u037f]"  # marks that compose with an ASCII letter are all among these


class SpaceTree:
    """Segment tree over remaining capacities 0..capacity: which have open bins, and the least at or above a need."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, space: int, is_open: bool) -> None:
        i = space + self.size
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        i = need + self.size
        if self.open[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan_packing(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over {length: pieces}: steps (length, first piece, pieces a bin, first bin, offset).

    A step's pieces, numbered among those of their length, fill its bins one after another.  Equal to packing
    pieces one at a time: of equal pieces the next one goes to the bin just used while it fits, for that is
    the tightest.
    """
    tree, bins, steps, made = SpaceTree(capacity), defaultdict(list), [], 0
    for length in sorted(histogram, reverse=True):
        left, nth = histogram[length], 0
        while left:
            space = tree.tightest(length)
            if space is None:
                space = capacity
                first, count = made, -(-left // (capacity // length))
                made += count
            else:
                first, count = bins[space].pop()
                if not bins[space]:
                    tree.set(space, False)
            each = space // length
            full = min(count, left // each)
            for n, per in ((full, each), (min(1, count - full), min(each, left - full * each))):
                if n and per:
                    steps.append((length, nth, per, first, capacity - space))
                    bins[space - per * length].append((first, n))
                    tree.set(space - per * length, True)
                    nth, left, first, count = nth + n * per, left - n * per, first + n, count - n
            if count:
                bins[space].append((first, count))
                tree.set(space, True)
    return steps


class WordBpe:
    """Tokenises texts word by word, keeping the ids of words it has seen.

    The tokenizer drops white space and lets nothing reach over it, so the ids of a text are those of its
    parts between ASCII white space, one after another.  It folds case, so ASCII letters are folded first, but
    not in texts with combining marks: a mark may compose with a small letter only.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self._keep({}, np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _keep(self, index: dict[bytes, int], ids: np.ndarray, ends: np.ndarray) -> None:
        self.index, self.ids, self.ends = index, ids, ends  # the ids of word i are ids[ends[i]:ends[i + 1]]

    def _ids(self, word: bytes) -> list[int]:
        return [t.id for t in self.model.model.tokenize(word.decode())]

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words not seen before."""
        found: list[list[int] | None] = []
        marks: dict[bytes, list[int]] = {}
        for w in words:
            letters = w.rstrip(MARKS)
            if letters.isalpha() and letters.islower():  # a run of letters and a run of marks are tokens' borders
                ids, mark = self._ids(letters), w[len(letters) :]
                if mark:
                    if mark not in marks:
                        marks[mark] = self._ids(mark)
                    ids += marks[mark]
                found.append(ids)
            else:
                found.append(None)
        rest = [i for i, x in enumerate(found) if x is None]
        for at in range(0, len(rest), 10_000):
            part = rest[at : at + 10_000]
            for i, e in zip(part, self.model.encode_batch_fast([words[i].decode("utf-8", "replace") for i in part], add_special_tokens=False)):
                found[i] = e.ids
        own = np.arange(len(self.index), len(self.index) + len(words))
        self.index.update(zip(words, own.tolist()))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in found], dtype=np.int64)])
        return own

    def __call__(self, texts: pa.Array, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by stop, and where each text begins (n + 1)."""
        texts = texts.fill_null("")
        folded = pc.ascii_lower(texts)
        _, data = binary_parts(texts)
        raw = np.frombuffer(data, np.uint8)
        if ((raw == 0xCC) | (raw == 0xCD)).any():
            folded = pc.if_else(pc.match_substring_regex(texts, COMBINING), texts, folded)
        words = pc.ascii_split_whitespace(folded)
        coded = words.flatten().cast(pa.binary()).dictionary_encode()
        known = coded.dictionary.to_pylist()
        if len(self.index) > CACHE_WORDS:
            n = CACHE_WORDS // 2  # words met early are the frequent ones
            self._keep(dict(islice(self.index.items(), n)), self.ids[: self.ends[n]], self.ends[: n + 1])
        own = np.fromiter(map(self.index.get, known, repeat(-1)), np.int64, len(known))
        new = np.flatnonzero(own < 0).tolist()
        if new:
            own[new] = self._learn([known[i] for i in new])
        first, code = self.ends[own], coded.indices.to_numpy()
        n = (self.ends[own + 1] - first)[code]
        before = np.concatenate([[0], np.cumsum(n)])
        offsets = words.offsets.to_numpy()
        begin = before[offsets - offsets[0]] + np.arange(len(offsets))  # every text has a stop of its own
        out = np.full(begin[-1], stop, "<u4")
        place = np.ones(len(out), bool)
        place[begin[1:] - 1] = False
        out[place] = self.ids[np.repeat(first[code] - before[:-1], n) + np.arange(before[-1])] if before[-1] else 0
        return out, begin


@lru_cache(maxsize=1)  # a worker keeps its words from task to task
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def _piece_rows(tokenizer: str, capacity: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = word_bpe(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, 500):
            tokens, begin = encode(batch.column("text"), end)
            size = np.diff(begin)
            pieces = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, size[row] - start)
            at = (begin[row] + start).tolist()
            own = [tokens[a : a + n] for a, n in zip(at, length.tolist())]
            nth = []
            for n in length.tolist():
                nth.append(seen[n])
                seen[n] += 1
            out = [
                batch.column("doc_id").take(pa.array(row)),
                pa.array(piece.astype(np.int32)),
                *(pa.array(x, pa.int64()) for x in (start, length, list(map(zlib.crc32, own)), nth, np.full(len(row), part))),
            ]
            yield pa.RecordBatch.from_arrays(out + [pa.array([x.tobytes() for x in own], pa.binary())] * with_ids, ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "part"] + ["ids"] * with_ids)

    return run


def _place_rows(steps: list[tuple[int, int, int, int, int]], columns: list[str]):
    table = np.array(sorted(steps), np.int64).reshape(-1, 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = table[:, 0]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):
                lo, hi = np.searchsorted(lengths, [n, n + 1])
                of = length == n
                at[of] = lo + np.searchsorted(table[lo:hi, 1], rank[of], side="right") - 1
            _, first, per, bin_, offset = table[at].T
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in columns), pa.array(bin_ + (rank - first) // per), pa.array(offset + (rank - first) % per * length)], [*columns, "sequence_id", "offset"]
            )

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, with_ids: bool = False, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Tokenise all documents and pack them into as few sequences of `capacity` tokens as best-fit decreasing finds.

    A document is its ids followed by `end`; only longer ones are cut, into pieces of `capacity`, the last
    one shorter.  Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and,
    if asked for, ids (little-endian unsigned 32-bit).  A null or empty text is one piece that holds only
    `end`; null and repeated ids are documents of their own; an empty table gives no rows.  Other columns are
    not read.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    pieces = staged(
        texts.mapInArrow(_piece_rows(tokenizer, capacity, end, with_ids), f"{schema}, nth long, part long" + ", ids binary" * with_ids), "pieces"
    )
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    ranked = pieces.join(base.hint("shuffle_merge"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.mapInArrow(_place_rows(plan_packing(histogram, capacity), columns), f"{schema}" + ", ids binary" * with_ids + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from pieces with ids; each is bounded by the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.transform(parts, lambda p: p["ids"]), F.lit(b""), lambda a, b: F.concat(a, b))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
