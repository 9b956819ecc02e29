"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

A text is cut into windows of WINDOW bytes; a network runs over each window forwards and backwards from a zero
state and labels every byte; the mean of the label probabilities over all bytes of all windows is the text's.
Training is by backpropagation through time with Adam on the driver, over a bounded sample of labelled windows
(`per_language` documents of each language, a few windows of each, drawn by hash from the whole text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplospark.llm.common import binary_parts, slices, small_batches, staged, unstage

WINDOW = 128
HIDDEN = 8
BATCH = 2048  # windows that advance together
LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, WINDOW) bytes, zero-padded; length of each window; windows per text."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    count = -(-size // WINDOW)
    of = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(WINDOW, size[of] - nth * WINDOW)
    out = np.zeros((len(of), WINDOW), np.uint8)
    out[np.arange(WINDOW) < length[:, None]] = raw
    return out, length, count


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    np.add(x, 1, out=x)
    return np.multiply(x, 0.5, out=x)


class BiGRU:
    """Weights by name; E* embed bytes into gate inputs (with biases), U* act on the state, V and c label."""

    def __init__(self, languages: list[str], weights: dict[str, np.ndarray] | None = None, seed: int = 11):
        self.languages, n, h = languages, len(languages), HIDDEN
        rng = np.random.default_rng(seed)
        self.w = weights or {
            **{f"E{d}": rng.normal(0, 0.3, (3 * h, 256)) for d in "fb"},
            **{f"U{d}": rng.normal(0, 0.3, (3 * h, h)) for d in "fb"},
            "V": rng.normal(0, 0.3, (n, 2 * h)),
            "c": np.zeros((n, 1)),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _scan(self, way: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (time, hidden, windows) after each byte in reading order; x: (time, windows) bytes."""
        h, (time, n) = HIDDEN, x.shape
        table, recur = np.ascontiguousarray(self.w[f"E{way}"].T), self.w[f"U{way}"]
        states, state = np.empty((time, h, n), np.float32), np.zeros((h, n), np.float32)
        for t in range(time):
            gate = table[x[t]].T
            g = gate[: 2 * h] + recur[: 2 * h] @ state
            _sigmoid(g)
            reset, update = g[:h], g[h:]
            held = reset * state
            new = np.tanh(gate[2 * h :] + recur[2 * h :] @ held)
            if keep is not None:
                keep.append((state, reset, update, held, new))
            state = state + update * (new - state)
            states[t] = state
        return states

    def label(self, windows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum over the bytes of each window of their label probabilities, (windows, languages)."""
        x = np.ascontiguousarray(windows.T)
        ahead, back = self._scan("f", x), self._scan("b", x[::-1])[::-1]
        v, total = self.w["V"], np.zeros((len(self.languages), x.shape[1]), np.float32)
        for t in range(len(x)):
            z = v[:, :HIDDEN] @ ahead[t] + v[:, HIDDEN:] @ back[t] + self.w["c"]
            np.exp(z - z.max(axis=0), out=z)
            z *= (t < length) / z.sum(axis=0)
            total += z
        return total.T

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean label probabilities of each text; zeros for an empty one."""
        windows, length, count = windows_of(texts)
        total = np.zeros((len(windows), len(self.languages)))
        for at in range(0, len(windows), BATCH):
            total[at : at + BATCH] = self.label(windows[at : at + BATCH], length[at : at + BATCH])
        out = np.zeros((len(texts), len(self.languages)))
        full = np.flatnonzero(count)
        if len(full):
            out[full] = np.add.reduceat(total, (np.cumsum(count) - count)[full], axis=0) / np.array([len(texts[i]) for i in full])[:, None]
        return out

    def gradients(self, windows: np.ndarray, length: np.ndarray, answer: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over bytes and its gradients, by backpropagation through time."""
        h, x = HIDDEN, np.ascontiguousarray(windows.T)
        time, n = x.shape
        kept: dict[str, list] = {"f": [], "b": []}
        state = {"f": self._scan("f", x, kept["f"]), "b": self._scan("b", x[::-1], kept["b"])[::-1]}
        both = np.concatenate([state["f"], state["b"]], axis=1)
        z = np.einsum("lh,thn->tln", self.w["V"], both, optimize=True) + self.w["c"]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        mask = (np.arange(time)[:, None] < length) / length.sum()
        loss = -float((np.log(p[:, answer, np.arange(n)] + 1e-12) * mask).sum())
        p[:, answer, np.arange(n)] -= 1
        p *= mask[:, None, :]
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["V"] = np.einsum("tln,thn->lh", p, both, optimize=True)
        grad["c"] = p.sum(axis=(0, 2))[:, None]
        d_both = np.einsum("lh,tln->thn", self.w["V"], p, optimize=True)
        for way in "fb":
            seen = x if way == "f" else x[::-1]
            outer = d_both[:, :h] if way == "f" else d_both[::-1, h:]
            u, d_state = self.w[f"U{way}"], np.zeros((h, n), np.float32)
            for t in range(time - 1, -1, -1):
                before, reset, update, held, new = kept[way][t]
                d = d_state + outer[t]
                d_new = d * update * (1 - new * new)
                d_update = d * (new - before) * update * (1 - update)
                d_held = u[2 * h :].T @ d_new
                d_reset = d_held * before * reset * (1 - reset)
                gates = np.concatenate([d_reset, d_update])
                d_state = d * (1 - update) + d_held * reset + u[: 2 * h].T @ gates
                grad[f"U{way}"][: 2 * h] += gates @ before.T
                grad[f"U{way}"][2 * h :] += d_new @ held.T
                np.add.at(grad[f"E{way}"].T, seen[t], np.concatenate([gates, d_new]).T)
        return loss, {k: v.astype(np.float32) for k, v in grad.items()}

    def fit(self, windows: np.ndarray, length: np.ndarray, answer: np.ndarray, steps: int = 250, size: int = 128, rate: float = 0.02, seed: int = 5) -> None:
        """Adam over random batches."""
        rng, m, s = np.random.default_rng(seed), {}, {}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(windows), size)
            _, grad = self.gradients(windows[pick], length[pick], answer[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g / max(1.0, norm)
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                s[k] = 0.99 * s.get(k, 0) + 0.01 * g * g
                way = rate * (1 - 0.9 * step / steps)
                self.w[k] -= (way * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls in this part; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def _sample_rows(each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            offsets, data = binary_parts(batch.column("text"))
            lang, part = [], []
            for i, (a, b, name) in enumerate(zip(offsets, offsets[1:], batch.column("lang").to_pylist())):
                starts = range(int(a), int(b), WINDOW)
                stride = max(1, len(starts) // each)
                for at in starts[:: stride][:each] if stride > 1 else starts:
                    lang.append(name)
                    part.append(bytes(data[at : min(at + WINDOW, int(b))]))
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(part, pa.binary())], ["lang", "part"])

    return run


def _by_language(values: dict[str, int]) -> Column:
    out = F.lit(None).cast("long")
    for lang, value in sorted(values.items()):
        out = F.when(F.col("lang") == lang, F.lit(value)).otherwise(out)
    return out


def train_language_model(labelled: DataFrame, per_language: int = 300, windows: int = 16) -> BiGRU | None:
    """Fit on (text, lang): at most `per_language` documents of a language, `windows` spread windows of each.

    Documents are chosen by the hash of their text, copies once, so any order of the rows gives the same model; null or
    empty texts and null languages are left out; None if nothing is left.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null and text <> ''")
    keyed = rows.select("lang", "text", F.xxhash64("text", F.lit(1)).alias("key"))
    # which keys are the least of a language is told from the keys alone: first by counts of their 4096 ranges, so that
    # only keys of the ranges up to the one that holds the last key wanted are ranked; texts of that key may be more
    keys = staged(keyed.select("lang", "key").distinct(), "keys")
    span = F.shiftright("key", 52)
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    spans = keys.groupBy("lang", span.alias("span")).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    ends = spans.where(F.col("before") < per_language).groupBy("lang").agg(F.max("span").alias("x")).collect()
    if not ends:
        unstage(keys)
        return None
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    few = keys.where(span <= _by_language({r["lang"]: r["x"] for r in ends})).withColumn("n", rank).where(F.col("n") <= per_language)
    last = {r["lang"]: r["x"] for r in few.groupBy("lang").agg(F.max("key").alias("x")).collect()}
    unstage(keys)
    once = keyed.where(F.col("key") <= _by_language(last)).dropDuplicates(["lang", "key"])
    got = once.select("lang", "text").mapInArrow(_sample_rows(windows), "lang string, part binary").toArrow()
    if not got.num_rows:
        return None
    part, lang = np.array(got["part"].to_pylist(), object), np.array(got["lang"].to_pylist(), object)
    order = sorted(range(len(part)), key=lambda i: (lang[i], part[i]))
    part, lang = part[order], lang[order]
    languages = sorted(set(lang))
    answer = np.array([languages.index(x) for x in lang])
    # as many windows of each language as of the most frequent one
    most = np.bincount(answer).max()
    rng = np.random.default_rng(3)
    even = np.concatenate([np.concatenate([own := np.flatnonzero(answer == k), rng.choice(own, most - len(own))]) for k in range(len(languages))])
    x, length, _ = windows_of([part[i] for i in even])
    model = BiGRU(languages)
    model.fit(x, length, answer[even])
    return model


def _predict_rows(languages: list[str], weights: dict[str, np.ndarray] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = BiGRU(languages, weights) if languages else None
        for batch in slices(batches, 512):
            offsets, data = binary_parts(batch.column("text"))
            texts = [bytes(data[a:b]) for a, b in zip(offsets, offsets[1:])]
            named = np.array([bool(_ASCII_LETTER[np.frombuffer(t[:64], np.uint8)].any()) or LETTER.search(t.decode("utf-8", "replace")) is not None for t in texts], bool)
            if model is None:
                named[:] = False
            best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            if named.any():
                p = model.probabilities([texts[i] for i in np.flatnonzero(named)])
                best[named], score[named] = p.argmax(axis=1), np.clip(p.max(axis=1), 0, 1)
            pred = [languages[b] if n else "und" for b, n in zip(best, named)]
            carried = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(pred, pa.string()), pa.array(score)], [*carried, "lang_pred", "score"])

    return run


def identify_language(docs: DataFrame, model: BiGRU | None, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns with lang_pred and score (0 to 1) of every whole text.

    Null texts, and texts without a letter, are `und` with score 0, and so is all if there was nothing to learn;
    rows are judged each by itself; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*carry, F.col(text_col).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_predict_rows(model.languages if model else [], model.w if model else None), f"{kinds}, lang_pred string, score double")
