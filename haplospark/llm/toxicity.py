"""Toxicity scores by weak supervision.

Voters are lexicon words and patterns (beginnings of words), mined from all labelled rows for learning: those
far more frequent in toxic than in other texts, besides a short list of insults.  A generative label model
takes their votes, and the given label as one more voter, and estimates by expectation-maximisation each
voter's rates given the class, and the voters' correlations within a class, by which it discounts voters that say
the same.  A voter that finds nothing abstains; that none speaks is a vote of its own.  A linear classifier over votes, vote counts and frequent words is trained on its posterior labels
and scores every whole text.  Mining and the label model count all labelled rows, the latter by vote pattern; the
linear classifier sees at most `sample` distinct texts of each class.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplospark.llm.common import binary_parts, slices, small_batches, staged, unstage

INSULTS = (b"idiot", b"moron", b"stupid", b"loser", b"scum", b"trash", b"pathetic", b"worthless", b"disgusting", b"clown")
PREFIXES = (3, 4, 5, 6, 7, 8)  # bytes of the beginnings of words that patterns look at
CACHE_WORDS = 400_000
MEASURES = 4
_FOLD = bytes(ord(chr(b).lower()) if 65 <= b < 91 else (32 if b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128 else b) for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words: runs of letters, digits and non-ASCII characters."""
    return text.translate(_FOLD).split()


def terms_of(word: bytes) -> list[bytes]:
    """A word as lexicon term (=word) and its beginnings as pattern terms (^be)."""
    return [b"=" + word, *(b"^" + word[:n] for n in PREFIXES if n < len(word))]


class _Index(dict):
    """Word -> ids of its terms that are in a vocabulary; forgets all when it grows too large."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        own = self[word] = tuple(i for t in terms_of(word) if (i := self.vocabulary.get(t)) is not None)
        return own


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in slices(batches, 512):
        offsets, data = binary_parts(batch.column("text"))
        yield batch, [bytes(data[a:b]) for a, b in zip(offsets, offsets[1:])]


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["term", "n"])

    for _, texts in _texts(batches):
        for text in texts:
            count.update({t for w in set(words_of(text)) for t in terms_of(w)})
            if len(count) >= CACHE_WORDS:
                yield rows()
                count.clear()
    yield rows()


@dataclass
class ToxicityModel:
    """Terms by id (the first `voters` of them vote), linear weights over terms and over vote measures."""

    terms: list[bytes] = field(default_factory=list)
    voters: int = 0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(MEASURES))
    bias: float = -3.0

    def features(self, texts: list[bytes], index: _Index | None = None) -> tuple[list[list[int]], np.ndarray]:
        """Ids of the terms in each text, and its measures: distinct votes, votes in all, votes per word, none."""
        index = index or _Index({t: i for i, t in enumerate(self.terms)})
        ids, measures = [], np.zeros((len(texts), MEASURES))
        for k, text in enumerate(texts):
            words = words_of(text)
            hits = [h for h in map(index.__getitem__, words) if h]
            own = {i for h in hits for i in h}
            ids.append(sorted(own))
            strong = sum(any(i < self.voters for i in h) for h in hits)
            measures[k] = np.log1p(len({min(h) for h in hits if min(h) < self.voters})), np.log1p(strong), min(1.0, 20 * strong / max(1, len(words))), float(not strong)
        return ids, measures

    def scores(self, texts: list[bytes], index: _Index | None = None) -> np.ndarray:
        ids, measures = self.features(texts, index)
        w, n = self.weights, len(self.terms)
        z = np.array([w[own].sum() for own in ids]) + measures @ w[n:] + self.bias if texts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def mine_terms(labelled: DataFrame, max_voters: int = 150, max_terms: int = 500, least: int = 3) -> tuple[list[bytes], int]:
    """Vocabulary and how many of it vote, from all rows of (text, toxic).

    A term votes that is in `least` toxic texts, whatever their number, and whose lift is above 2 and above
    1.645 times its standard error; of more than `max_voters` those that tell the classes apart best.
    """
    by_class = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = by_class.get(1, 0), by_class.get(0, 0)

    def counts(toxic: int, name: str) -> DataFrame:
        return labelled.where(F.col("toxic") == toxic).select("text").mapInArrow(_term_rows, "term binary, n long").groupBy("term").agg(F.sum("n").alias(name))

    found, clean = F.col("found"), F.coalesce("clean", F.lit(0))
    known = counts(1, "found").where(found >= least).join(counts(0, "clean"), "term", "left")
    lift = F.log((found + 0.5) / (n1 + 1)) - F.log((clean + 0.5) / (n0 + 1))
    # the gain of a term in telling the classes apart: frequent and one-sided ones first
    known = staged(known.select("term", "found", lift.alias("lift"), F.sqrt(1 / (found + 0.5) + 1 / (clean + 0.5)).alias("error")), "terms")
    strong = [bytes(r["term"]) for r in known.where("lift > 2 and lift > 1.645 * error").orderBy(F.desc(F.col("found") * F.col("lift")), "term").limit(max_voters).collect()]
    own = [b"=" + w for w in INSULTS if b"=" + w not in strong]
    rest = known.where(F.col("lift") <= 2).where(F.substring("term", 1, 1) == F.lit(b"=")).orderBy(F.desc("found"), "term").limit(max_terms).collect()
    unstage(known)
    listed = {*strong, *own}
    rest = [t for r in rest if (t := bytes(r["term"])) not in listed][: max_terms - len(strong) - len(own)]
    return strong + own + rest, len(strong) + len(own)


def posterior(x: np.ndarray, given: np.ndarray, model: dict) -> np.ndarray:
    """Probability of label 1 of each row of votes under a label model; an empty model trusts the given label."""
    if not model:
        return np.where(given > 0, 0.95, 0.05)
    z = model["prior"] + x @ model["evidence"] + (1.0 - x.max(axis=1, initial=0)) * model["silence"] + np.where(given > 0, 1, -1) * np.log(19.0)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def vote_sums(x: np.ndarray, given: np.ndarray, count: np.ndarray, model: dict) -> np.ndarray:
    """What a round needs of rows that occur `count` times: sums of 1, q, q^2, silence, q * silence, votes, q * votes."""
    q = posterior(x, given, model)
    c, none = count * q, 1.0 - x.max(axis=1, initial=0)
    return np.concatenate([[count.sum(), c.sum(), c @ q, count @ none, c @ none], count @ x, c @ x])


def label_rounds(sums, together: np.ndarray, rounds: int = 20) -> dict:
    """The label model, from sums(model) over all rows and the sums of products of two votes."""
    model: dict = {}
    v = len(together)
    for _ in range(rounds):
        s = sums(model)
        n, n1, qq, none, none1 = s[:5]
        yes1, yes0, n0 = s[5 + v :], s[5 : 5 + v] - s[5 + v :], n - n1
        p1, p0 = (yes1 + 0.5) / (n1 + 1), (yes0 + 0.5) / (n0 + 1)
        crossed, mixed = np.outer(yes1, p1) + np.outer(yes0, p0), np.outer(p1, p0)
        cov = (together - crossed - crossed.T + qq * np.outer(p1, p1) + (n1 - qq) * (mixed + mixed.T) + (n - 2 * n1 + qq) * np.outer(p0, p0)) / n
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = cov / np.outer(sd, sd)
        evidence = np.log(p1 / p0) / np.maximum(1.0, (corr**2).sum(axis=1))
        silence = np.log((none1 + 0.5) / (n1 + 1)) - np.log((none - none1 + 0.5) / (n0 + 1))
        model = {"yes_given_1": p1, "yes_given_0": p0, "correlation": corr, "evidence": evidence, "silence": silence, "prior": np.log((n1 + 1) / (n0 + 1))}
    return model


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posterior probability of label 1 of each row, and the model, from 0/1 votes and given labels.

    Given the class, voters say yes at rates estimated by expectation-maximisation; a voter counts as
    1 / (sum of its squared correlations within classes), so voters that repeat each other share one voice.
    The given label is a voter that is right in 19 of 20 cases.
    """
    x = votes.astype(np.float64)
    model = label_rounds(lambda m: vote_sums(x, given, np.ones(len(x)), m), x.T @ x, rounds)
    return posterior(x, given, model), model


def label_model_of(patterns: DataFrame, voters: int) -> dict:
    """The label model of (votes, toxic, n): each pattern of votes and given label with its number of rows."""

    def total(of, width: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(width)
            for batch in slices(batches, 4096):
                votes = batch.column("votes")
                x = np.zeros((batch.num_rows, voters))
                x[np.repeat(np.arange(len(x)), np.diff(votes.offsets.to_numpy())), votes.flatten().to_numpy()] = 1
                out += of(x, batch.column("toxic").to_numpy(), batch.column("n").to_numpy().astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], ["sums"])

        return sum((np.frombuffer(r["sums"]) for r in patterns.mapInArrow(run, "sums binary").collect()), np.zeros(width))

    together = total(lambda x, given, n: ((x * n[:, None]).T @ x).ravel(), voters * voters).reshape(voters, voters)
    return label_rounds(lambda m: total(lambda x, given, n: vote_sums(x, given, n, m), 5 + 2 * voters), together)


def linear_classifier(x: np.ndarray, target: np.ndarray, start: np.ndarray, bias: float, penalty: np.ndarray, rounds: int = 400, rate: float = 0.5, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic weights by gradient descent with momentum on soft labels, drawn towards where they start."""
    w, b, v, vb = start.copy(), bias, np.zeros(x.shape[1]), 0.0
    weight = np.full(len(x), 1 / len(x)) if weight is None else weight / weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40)))
        e = (p - target) * weight
        v, vb = 0.9 * v - rate * (x.T @ e + penalty * (w - start)), 0.9 * vb - rate * e.sum()
        w, b = w + v, b + vb
    return w, float(b)


def train_toxicity(labelled: DataFrame, sample: int = 6000) -> ToxicityModel:
    """Fit on (text, toxic); null texts are empty, rows without a label are left out.

    The label model counts all rows.  The classifier sees of each class the `sample` distinct texts of least
    hash, weighted to the class's number of distinct texts, so neither the order of rows nor copies matter.  With no
    toxic rows only the listed insults vote, at a fixed weight.
    """
    small_batches(labelled.sparkSession)
    rows = staged(labelled.select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)"), "labelled")
    terms, voters = mine_terms(rows)
    model = ToxicityModel(terms, voters)
    n = len(terms)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index({t: i for i, t in enumerate(terms[:voters])})
        for batch, texts in _texts(batches):
            votes = [sorted({i for w in set(words_of(text)) for i in index[w]}) for text in texts]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.list_(pa.int32())), batch.column("toxic")], ["votes", "toxic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index({t: i for i, t in enumerate(terms)})
        for batch, texts in _texts(batches):
            ids, measures = model.features(texts, index)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(measures.tolist(), pa.list_(pa.float64())), batch.column("toxic"), batch.column("key")], ["ids", "measures", "toxic", "key"])

    keyed = rows.select("text", "toxic", F.xxhash64("text", F.lit(2)).alias("key"))
    keys = staged(keyed.select("toxic", "key").distinct(), "keys")
    distinct = {r["toxic"]: r["n"] for r in keys.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if 1 not in distinct:
        unstage(rows, keys)
        model.weights = np.concatenate([np.zeros(n), [2.0, 2.0, 0.0, 0.0]])
        return model
    patterns = staged(rows.mapInArrow(vote, "votes array<int>, toxic int").groupBy("votes", "toxic").agg(F.count(F.lit(1)).alias("n")), "patterns")
    rates = label_model_of(patterns, voters)
    last = {c: keys.where(F.col("toxic") == c).orderBy("key").limit(sample).agg(F.max("key")).first()[0] for c in distinct}
    chosen = keyed.where(" or ".join(f"(toxic = {c} and key <= {k})" for c, k in last.items()))
    few = chosen.mapInArrow(run, "ids array<int>, measures array<double>, toxic int, key long").dropDuplicates(["key", "toxic"]).orderBy("key", "toxic").toArrow()
    unstage(rows, keys, patterns)
    given = np.array(few["toxic"].to_pylist(), np.int64)
    x = np.zeros((len(given), n + MEASURES))
    for i, own in enumerate(few["ids"].to_pylist()):
        x[i, own] = 1
    x[:, n:] = few["measures"].to_pylist()
    start = np.zeros(n + MEASURES)
    start[:voters], start[-1] = rates["evidence"], rates["silence"]
    penalty = np.concatenate([np.full(voters, 1e-3), np.full(n - voters, 3e-3), np.full(MEASURES, 1e-4)])
    weight = np.array([distinct.get(c, 0) / max(1, (given == c).sum()) for c in (0, 1)])[given]
    model.weights, model.bias = linear_classifier(x, posterior(x[:, :voters], given, rates), start, float(rates["prior"]), penalty, weight=weight)
    return model


def _score_rows(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index({t: i for i, t in enumerate(model.terms)})
        for batch, texts in _texts(batches):
            carried = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(model.scores(texts, index))], [*carried, "score"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, least: float = 0.7, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns with score (0 to 1) and predicted (1 from `least` on) of every whole text.

    Null and empty texts get the score of a text without words; rows are scored each by itself; an empty
    table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*carry, F.col(text_col).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_score_rows(model), f"{kinds}, score double").withColumn("predicted", (F.col("score") >= least).cast("int"))
