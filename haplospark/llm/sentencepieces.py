"""SentencePiece encoding and decoding with a public vocabulary: Viterbi over piece scores, batched in numpy.

A text, with a space put before it, is cut where a run of spaces begins; no piece reaches over such a place,
so the parts are encoded by themselves.  Parts not seen before are grouped by length and advance together: at each
position the hashes of the substrings that end there are looked up among the sorted keys of all pieces, the
best sum of scores is kept, and the length of the last piece is its backpointer.  Equal sums take the longer last
piece.  Characters without a piece become the byte pieces of their UTF-8 form.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplospark.llm.common import binary_parts, mix64, slices, small_batches

SPACE = "▁"
PARTS = re.compile(f"{SPACE}+[^{SPACE}]*|^[^{SPACE}]+")
CACHE_PARTS = 600_000  # encoded parts that a worker keeps
BASE = 0x9E3779B97F4A7C15 | 1
MARK_BITS = 21
MARK = np.uint64((1 << MARK_BITS) - 1)


class Pieces:
    """A vocabulary file: keys of its pieces in order, their scores, and the bytes each id stands for."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.unknown_id = model.unk_id()
        self.byte_ids = np.full(256, self.unknown_id, np.int64)
        self.raw: list[bytes] = []
        plain = []
        for i in ids:
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = i
                self.raw.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                self.raw.append(piece.replace(SPACE, " ").encode())
                plain.append((piece, model.get_score(i), i))
        self.longest = max(len(p) for p, _, _ in plain)
        self.powers = np.array([pow(BASE, k, 1 << 64) for k in range(1 << 12)], np.uint64)
        self.inverse = np.array([pow(pow(BASE, -1, 1 << 64), k, 1 << 64) for k in range(1 << 12)], np.uint64)
        keys = np.array([self._key(p) for p, _, _ in plain], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one key")
        self.scores = np.array([s for _, s, _ in plain])[order]
        self.ids = np.array([i for _, _, i in plain])[order]
        self.unknown_score = float(self.scores.min()) - 10.0
        self.maybe = np.zeros(1 << MARK_BITS, bool)  # spares most substrings the search among the keys
        self.maybe[self.keys & MARK] = True

    def _key(self, piece: str) -> np.uint64:
        codes = np.array([[ord(c) for c in piece]], np.uint64)
        return self._names(self._prefix(codes), 0, len(piece))[0]

    def _prefix(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        np.cumsum(mix64(codes) * self.powers[: codes.shape[1]], axis=1, out=out[:, 1:])
        return out

    def _names(self, prefix: np.ndarray, begin: int, end: int) -> np.ndarray:
        return mix64((prefix[:, end] - prefix[:, begin]) * self.inverse[begin] + np.uint64(end - begin))

    def viterbi(self, parts: list[str]) -> list[tuple[float, list[int]]]:
        """(score, ids) of parts that all have one length."""
        n, length = len(parts), len(parts[0])
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, length).astype(np.uint64)
        if length >= len(self.powers):  # a part longer than the table of powers
            more = range(len(self.powers), length + 1)
            self.powers = np.concatenate([self.powers, np.array([pow(BASE, k, 1 << 64) for k in more], np.uint64)])
            self.inverse = np.concatenate([self.inverse, np.array([pow(pow(BASE, -1, 1 << 64), k, 1 << 64) for k in more], np.uint64)])
        prefix = self._prefix(codes)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, length + 1), np.int32), np.full((n, length + 1), -1, np.int32)
        for end in range(1, length + 1):
            for size in range(min(self.longest, end), 0, -1):
                key = self._names(prefix, end - size, end)
                rows = np.flatnonzero(self.maybe[key & MARK])
                at = np.minimum(np.searchsorted(self.keys, key[rows]), len(self.keys) - 1)
                known = self.keys[at] == key[rows]
                rows, at = rows[known], at[known]
                total = best[rows, end - size] + self.scores[at]
                better = total > best[rows, end]
                rows, at = rows[better], at[better]
                best[rows, end], back[rows, end], piece[rows, end] = total[better], size, self.ids[at]
                if size == 1:
                    rows = np.flatnonzero(best[:, end - 1] + self.unknown_score > best[:, end])
                    best[rows, end], back[rows, end], piece[rows, end] = best[rows, end - 1] + self.unknown_score, 1, -1
        out = []
        for part, score, sizes, found in zip(parts, best[:, length].tolist(), back.tolist(), piece.tolist()):
            ids, at = [], length
            while at:
                if found[at] >= 0:
                    ids.append(found[at])
                else:
                    ids.extend(int(i) for i in self.byte_ids[np.frombuffer(part[at - 1].encode("utf-8", "replace"), np.uint8)][::-1])
                at -= sizes[at]
            out.append((score, ids[::-1]))
        return out

    def parts(self, text: str) -> list[str]:
        """The parts of a text, a space put before it; none of an empty one."""
        if not text:
            return []
        if "  " not in text and SPACE not in text and text[0] != " ":
            return [SPACE + w for w in text.split(" ")]
        return PARTS.findall(SPACE + text.replace(" ", SPACE))

    def encode_parts(self, parts: list[str]) -> dict[str, tuple[float, list[int]]]:
        by_length: dict[int, list[str]] = {}
        for p in parts:
            by_length.setdefault(len(p), []).append(p)
        out = {}
        for length, group in by_length.items():
            step = max(1, (1 << 18) // (length + 1))
            for at in range(0, len(group), step):
                some = group[at : at + step]
                out.update(zip(some, self.viterbi(some)))
        return out

    def encode(self, text: str) -> tuple[float, list[int]]:
        parts = self.parts(text)
        done = self.encode_parts(sorted(set(parts)))
        return sum(done[p][0] for p in parts), [i for p in parts for i in done[p][1]]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space put before the text is taken off again."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=1)
def _kept(path: str) -> dict[str, bytes]:
    return {}


def encode_texts(path: str, texts: list[str]) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text; a worker keeps the parts it has seen."""
    model, cache = pieces(path), _kept(path)
    parts = [model.parts(t) for t in texts]
    new = {p for own in parts for p in own if p not in cache}
    if len(cache) + len(new) > CACHE_PARTS:
        first = list(islice(cache.items(), CACHE_PARTS // 2))  # parts met early are the frequent ones
        cache.clear()
        cache.update(first)
        new = {p for own in parts for p in own if p not in cache}
    cache.update((p, np.array(ids, "<u4").tobytes()) for p, (_, ids) in model.encode_parts(sorted(new)).items())
    return [b"".join(map(cache.__getitem__, own)) for own in parts]


def _encode_rows(path: str, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            offsets, data = binary_parts(batch.column("text"))
            texts = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:])]
            ids = encode_texts(path, texts)
            carried = [c for c in batch.schema.names if c != "text"]
            if check:
                model = pieces(path)
                same = [model.decode(np.frombuffer(i, "<u4")) == t for i, t in zip(ids, texts)]
                more = {"n_ids": pa.array([len(i) // 4 for i in ids], pa.int64()), "ids_crc32": pa.array([zlib.crc32(i) for i in ids], pa.int64()), "round_trip": pa.array(same, pa.bool_())}
            else:
                more = {"ids": pa.array(ids, pa.binary())}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *more.values()], [*carried, *more])

    return run


def _decode_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            carried = [c for c in batch.schema.names if c != "ids"]
            texts = [None if i is None else model.decode(np.frombuffer(i, "<u4")) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(texts, pa.string())], [*carried, "text"])

    return run


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), check: bool = False) -> DataFrame:
    """The carried columns with ids (little-endian unsigned 32-bit) of every whole text.

    With check: n_ids, ids_crc32 and round_trip (whether decoding gives the text back) instead of ids.  Null
    and empty texts have no ids; the mark that stands for a space in pieces decodes to a space where a text
    holds it itself; rows are encoded each by itself; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*carry, F.col(text_col).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_encode_rows(path, check), f"{kinds}, n_ids long, ids_crc32 long, round_trip boolean" if check else f"{kinds}, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """Encoded rows with text in place of ids; null ids give a null text."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "ids")
    return encoded.mapInArrow(_decode_rows(path), f"{kinds}, text string")
