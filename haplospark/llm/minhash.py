"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of five-word shingles, counted over all documents in 2^18 hashed buckets.  A shingle
   weighs tf * (1 + DAMP * idf), idf scaled to 0..1: frequent boilerplate counts somewhat less, and unweighted
   similarity stays near the weighted one.
2. Each document's shingles are sampled K times, each sample being equal in two documents with the probability
   of their weighted Jaccard similarity; samples are banded.
3. Documents of equal words form one class, of which one member goes on.
4. Small buckets propose all their pairs, at most six; in larger ones each member is paired with the least.  Texts of
   each pair are compared exactly.  In larger buckets that verified links do not connect, members outside the
   largest component are then held against all members of other components, in pairs of blocks of bounded size:
   first sketch against sketch, then exactly, with the texts of only those members that look alike.  So a link
   between two members of which neither resembles the least one is not lost.  The largest component is not
   paired with itself, so a bucket costs its size times the blocks of its other members.
5. Connected components of the verified links, by min-label propagation with pointer jumping in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplospark.llm.common import binary_parts, bucketed, keyed_texts, mix64, released, slices, small_batches, staged, unstage
from haplospark.llm.suffix_dedup import Hasher

WORDS = 5
BUCKET_BITS = 18  # of document frequencies
DAMP = 0.1
BANDS, ROWS = 12, 4
K = BANDS * ROWS
TABLE_BITS = 16  # draws of a sample come from a table of so many entries
ALL_PAIRS = 4  # largest bucket of which all pairs are compared
BLOCK_ROWS, BLOCK_WORDS = 512, 500_000  # about so many documents or words are in a block of a bucket
BYTES = 1 << 20  # of text handled at a time
ALIKE = 20  # equal samples of 48 from which texts are compared: a pair at 0.8 has fewer once in a thousand million

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(texts: list[memoryview], hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all five-word shingles of the texts in order, their first index per text (n + 1), words per text.

    Words are runs without white space, ASCII letters in lower case.  A text of one to four words is one
    shingle.
    """
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    text = _LOWER[raw]
    ends = np.cumsum([len(t) + 1 for t in texts])
    word = ~_SPACE[text]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    prefix = hasher.prefix(text)
    w = hasher.of(prefix, begin, end)
    last = np.searchsorted(begin, ends)  # words before the end of each text
    n_words = np.diff(last, prepend=0)
    n = np.where(n_words >= WORDS, n_words - WORDS + 1, np.minimum(n_words, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    if not at[-1]:
        return np.zeros(0, np.uint64), at, n_words
    of = np.repeat(np.arange(len(texts)), n)
    first = (last - n_words)[of] + np.arange(at[-1]) - at[of]
    padded = np.concatenate([w, np.zeros(WORDS, np.uint64)])
    h = np.zeros(at[-1], np.uint64)
    for j in range(WORDS):
        part = padded[first + j] * _STEP[j]
        if (n_words < WORDS).any():
            part[n_words[of] <= j] = 0
        h += part
    return mix64(h + np.minimum(n_words[of], WORDS).astype(np.uint64)), at, n_words


def _blocks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[memoryview]]]:
    """Rows of at most BYTES of text together, or one longer text."""
    for batch in batches:
        offsets, data = binary_parts(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            stop = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + BYTES, side="right")) - 1)
            yield batch.slice(begin, stop - begin), [data[a:b] for a, b in zip(offsets[begin:stop], offsets[begin + 1 : stop + 1])]
            begin = stop


def _frequency_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, total = Hasher(BYTES), np.zeros((1 << BUCKET_BITS) + 1, np.int64)
    for _, texts in _blocks(batches):
        h, at, _ = shingles(texts, hasher)
        bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        own = np.unique((np.repeat(np.arange(len(texts)), np.diff(at)) << BUCKET_BITS) | bucket)
        total[:-1] += np.bincount(own & ((1 << BUCKET_BITS) - 1), minlength=1 << BUCKET_BITS)
        total[-1] += (np.diff(at) > 0).sum()
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])


def shingle_weights(texts: DataFrame) -> np.ndarray:
    """Weight of one occurrence of a shingle, by hashed bucket; 2^18 numbers whatever the corpus."""
    counts = texts.select("text").mapInArrow(released(_frequency_rows, "minhash"), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros((1 << BUCKET_BITS) + 1)
    df[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    n = df[-1]
    return (1 + DAMP * np.log((1 + n) / (1 + df[:-1])) / np.log(2 + n)).astype(np.float32)


def weighted(h: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of one text, ascending, and their TF-IDF weights."""
    h, tf = np.unique(h, return_counts=True)
    return h, tf.astype(np.float32) * weights[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]


class Sampler:
    """Improved consistent weighted sampling: per sample, draws r and c ~ Gamma(2, 1) and b ~ U(0, 1) by shingle."""

    def __init__(self) -> None:
        rng = np.random.default_rng(7)
        size = (K, 1 << TABLE_BITS)
        self.r = rng.gamma(2, 1, size).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, size)).astype(np.float32)
        self.b = rng.random(size).astype(np.float32)
        self.inv_r = 1 / self.r
        self.odd = rng.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def samples(self, h: np.ndarray, log_w: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(texts, K) sample names; every text has a shingle, and its shingles ascend."""
        out = np.empty((len(at) - 1, K), np.uint64)
        n = np.diff(at)
        for k in range(K):
            i = ((h * self.odd[k]) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            b, r = self.b[k][i], self.r[k][i]
            t = np.floor(log_w * self.inv_r[k][i] + b)
            a = self.log_c[k][i] - r * (t - b + 1)
            low = np.minimum.reduceat(a, at[:-1])
            hit = np.flatnonzero(a == np.repeat(low, n))
            hit = hit[np.searchsorted(hit, at[:-1])]  # of equal ones the least shingle
            out[:, k] = mix64(h[hit] * np.uint64(3) + t[hit].astype(np.int64).view(np.uint64))
        return out


def _signature_rows(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sampler = Hasher(BYTES), Sampler()
        for rows, texts in _blocks(batches):
            h, at, n_words = shingles(texts, hasher)
            place = (np.arange(len(h)) - np.repeat(at[:-1], np.diff(at))).astype(np.uint64)
            full = np.flatnonzero(np.diff(at))
            if not len(full):
                continue
            prints = [np.add.reduceat(mix64(h + place * c), at[:-1][full]).view(np.int64) for c in _STEP[:2]]
            own = [weighted(h[at[i] : at[i + 1]], weights) for i in full]
            starts = np.concatenate([[0], np.cumsum([len(x) for x, _ in own])])
            names = sampler.samples(np.concatenate([x for x, _ in own]), np.log(np.concatenate([w for _, w in own])), starts)
            bands = np.zeros((len(full), BANDS), np.uint64)
            for j in range(BANDS):
                key = np.full(len(full), j, np.uint64)
                for c in range(j * ROWS, (j + 1) * ROWS):
                    key = mix64(key * np.uint64(5) + names[:, c])
                bands[:, j] = key
            sketch = (names & np.uint64(0xFFFF)).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("row_id").take(pa.array(full)),
                    *(pa.array(p) for p in prints),
                    pa.array(n_words[full].astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel())),
                    pa.array([s.tobytes() for s in sketch], pa.binary()),
                ],
                ["row_id", "p1", "p2", "n_words", "bands", "sketch"],
            )

    return run


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets with ascending members."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    return both / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - both)


def _verify_rows(weights: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(BYTES)
        for batch in slices(batches, 128):
            out, last, left = [], None, None
            a_ids, b_ids = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            (ao, ad), (bo, bd) = binary_parts(batch.column("text_a")), binary_parts(batch.column("text_b"))
            for i, (a, b) in enumerate(zip(a_ids, b_ids)):
                if a != last:
                    last, left = a, weighted(shingles([ad[ao[i] : ao[i + 1]]], hasher)[0], weights)
                right = weighted(shingles([bd[bo[i] : bo[i + 1]]], hasher)[0], weights)
                s = similarity(left, right)
                if s >= least:
                    out.append((a, b, s))
            a, b, s = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "similarity"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, weights: np.ndarray, least: float) -> DataFrame:
    """Those of the distinct pairs (a, b) whose texts are at least so similar."""
    pairs = staged(pairs.distinct(), "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("row_id")).distinct()
    used = staged(texts.select("row_id", "text").join(nodes.hint("shuffle_merge"), "row_id"), "used")
    with_b = pairs.join(used.select(F.col("row_id").alias("b"), F.col("text").alias("text_b")).hint("shuffle_merge"), "b")
    both = with_b.join(used.select(F.col("row_id").alias("a"), F.col("text").alias("text_a")).hint("shuffle_merge"), "a")
    links = staged(both.select("a", "b", "text_a", "text_b").mapInArrow(released(_verify_rows(weights, least), "minhash"), "a long, b long, similarity double"), "links")
    unstage(pairs, used)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of the links (a, b) is connected with."""
    both = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component").hint("shuffle_merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        hooked = labels.join(near.hint("shuffle_merge"), "node", "left").select("node", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        target = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = staged(hooked.join(target.hint("shuffle_merge"), "component", "left").select("node", "was", F.least("component", "next").alias("component")), "labels")
        unstage(labels)
        labels = jumped
        if labels.where("component <> was").limit(1).count() == 0:
            unstage(both)
            return labels.select("node", "component")


BLOCK = "key long, i int, j int, side int, band int, node long, component long, sketch binary, bands array<long>"


class _Sketches:
    """Which members of a pair of blocks, in different components, have alike sketches.

    A pair that shares an earlier band too is left to that band's bucket.
    """

    def __init__(self, table: pa.Table):
        self.node, self.component, self.side, band = (table[c].to_numpy() for c in ("node", "component", "side", "band"))
        offsets, data = binary_parts(table["sketch"])
        self.sketch = np.frombuffer(data, "<u2")[offsets[0] // 2 : offsets[-1] // 2].reshape(-1, K)
        self.earlier = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)[:, : band[0]]

    def alike(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each member of the first block, and the members of the second one that look like it, the most alike first."""
        left, right = np.flatnonzero(self.side != 1), np.flatnonzero(self.side != 0)
        for i in left.tolist():
            own = right[right > i] if self.side[i] == 2 else right
            own = own[self.component[own] != self.component[i]]
            equal = (self.sketch[own] == self.sketch[i]).sum(axis=1)
            found = np.flatnonzero((equal >= ALIKE) & ~(self.earlier[own] == self.earlier[i]).any(axis=1))
            yield i, own[found[np.argsort(-equal[found], kind="stable")]]


def _alike_rows(table: pa.Table) -> pa.Table:
    """The members of a pair of blocks that look like a member of another component."""
    table, found = table.combine_chunks(), set()
    for i, own in _Sketches(table).alike():
        if len(own):
            found.update((i, *own.tolist()))
    return table.take(pa.array(sorted(found), pa.int64()))


@lru_cache(maxsize=1)  # its tables cost more than most groups
def _worker_hasher() -> Hasher:
    return Hasher(BYTES)


def _block_links(weights: np.ndarray, least: float):
    """Links between different components within one pair of blocks of a bucket.

    Members that look alike are compared exactly, unless links found here already connect them.
    """

    def run(table: pa.Table) -> pa.Table:
        hasher, table = _worker_hasher(), table.combine_chunks()
        blocks = _Sketches(table)
        node, component = blocks.node, blocks.component
        offsets, data = binary_parts(table["text"])
        sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        root = {c: c for c in component.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        def members(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in sets:
                sets[i] = weighted(shingles([data[offsets[i] : offsets[i + 1]]], hasher)[0], weights)
            return sets[i]

        out = []
        for i, own in blocks.alike():
            for j in own.tolist():
                x, y = find(component[i]), find(component[j])
                if x != y and (s := similarity(members(i), members(j))) >= least:
                    root[max(x, y)] = min(x, y)
                    out.append((min(node[i], node[j]), max(node[i], node[j]), s))
        a, b, s = zip(*out) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(s, pa.float64())})

    return run


def _block_pairs(placed: DataFrame) -> DataFrame:
    """Members of buckets of two components or more, once for each pair of blocks (i, j) that they take part in.

    Blocks are numbered from those outside the bucket's largest component on; two blocks of that one make no pair.
    """
    parts = staged(placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("w")), "parts")
    of = parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max(F.struct("n", "component", "w")).alias("top"), F.sum("n").alias("m"), F.sum("w").alias("words"), F.count(F.lit(1)).alias("parts"))

    def blocks(rows, words):
        return F.ceil(F.greatest(rows / BLOCK_ROWS, words / BLOCK_WORDS)).cast("int")

    of = of.where("parts > 1").select("key", "main", blocks(F.col("m") - F.col("top.n"), F.col("words") - F.col("top.w")).alias("others"), blocks(F.col("top.n"), F.col("top.w")).alias("mains"))
    met = placed.join(staged(of, "buckets").hint("shuffle_merge"), "key")
    hashed, is_main = F.xxhash64("node"), F.col("component") == F.col("main")
    met = met.withColumn("own", F.when(is_main, F.col("others") + F.pmod(hashed, F.col("mains"))).otherwise(F.pmod(hashed, F.col("others"))).cast("int"))
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "band", "node", "component")


def near_duplicates(texts: DataFrame, least: float = 0.8) -> DataFrame:
    """(row_id, component) of every row of (row_id, text); the component is the row_id of one of its members.

    Rows of the same component are near-duplicates of weighted similarity `least` or more, by links.  Null
    and empty texts and those without words stand alone; texts of equal words are together; texts of one to
    four words match only equal ones.  Row ids are distinct.
    """
    weights = shingle_weights(texts)
    signed = staged(
        texts.select("row_id", "text").mapInArrow(released(_signature_rows(weights), "minhash"), "row_id long, p1 long, p2 long, n_words long, bands array<long>, sketch binary"), "signed"
    )
    same = ["p1", "p2", "n_words"]
    classes = staged(signed.groupBy(*same).agg(F.min("row_id").alias("node")), "classes")
    member = staged(signed.select("row_id", *same).join(classes.hint("shuffle_merge"), same).select("row_id", "node"), "member")
    nodes = signed.join(member.where("row_id = node").select("row_id").hint("shuffle_merge"), "row_id")
    banded = staged(nodes.select(F.col("row_id").alias("node"), "n_words", F.posexplode("bands").alias("band", "key")), "banded")
    sizes = staged(banded.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("least")).where("m > 1"), "sizes")
    small = banded.join(sizes.where(F.col("m") <= ALL_PAIRS).hint("shuffle_merge"), "key").groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("all"))
    i_j = [(i, j) for j in range(1, ALL_PAIRS) for i in range(j)]
    few = small.select(F.explode(F.array(*[F.struct(F.try_element_at("all", F.lit(i + 1)).alias("a"), F.try_element_at("all", F.lit(j + 1)).alias("b")) for i, j in i_j])).alias("p")).select("p.*").where("b is not null")
    large = staged(banded.join(sizes.where(F.col("m") > ALL_PAIRS).hint("shuffle_merge"), "key"), "large")
    star = large.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    links = verified(few.unionByName(star), texts, weights, least)
    labels = components(links)
    # larger buckets that the links leave in two components or more
    placed = staged(large.join(labels.hint("shuffle_merge"), "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    dealt = staged(_block_pairs(placed), "dealt")
    sketches = signed.select(F.col("row_id").alias("node"), "sketch", "bands").join(dealt.select("node").distinct().hint("shuffle_merge"), "node")
    alike = dealt.join(sketches.hint("shuffle_merge"), "node").select("key", "i", "j", "side", "band", "node", "component", "sketch", "bands")
    alike = staged(alike.groupBy("key", "i", "j").applyInArrow(_alike_rows, BLOCK), "alike")
    used = texts.select("row_id", "text").join(alike.select(F.col("node").alias("row_id")).distinct().hint("shuffle_merge"), "row_id")
    met = alike.join(used.withColumnRenamed("row_id", "node").hint("shuffle_merge"), "node")
    extra = staged(met.groupBy("key", "i", "j").applyInArrow(_block_links(weights, least), "a long, b long, similarity double"), "links")
    unstage(dealt, alike)
    links = links.unionByName(extra)
    final = components(links)
    unstage(banded, sizes, large, placed)
    return _labelled(texts, member, final)


def _labelled(texts: DataFrame, member: DataFrame, final: DataFrame) -> DataFrame:
    of = member.join(final.hint("shuffle_merge"), "node", "left").select("row_id", F.coalesce("component", "node").alias("component"))
    rows = texts.select("row_id", "doc_id").join(of.hint("shuffle_merge"), "row_id", "left")
    return rows.select("row_id", "doc_id", F.coalesce("component", "row_id").alias("component"))


def minhash_near_dedup(docs: DataFrame, least: float = 0.8, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Near-duplicate classes of documents, and the keyed documents they refer to.

    First: row_id, doc_id, class_id (the least doc_id of the class; null if all are null), kept (true for one
    row of each class: the one with the least doc_id, then row).  Second: row_id, doc_id, text, rest (the other
    columns as one struct).  Null and empty texts stand alone and are kept; repeated rows are copies of each
    other; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    texts = bucketed(keyed_texts(docs, text_col, id_col, rest=True), "row_id", "texts")
    found = staged(near_duplicates(texts, least), "found")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("row_id").alias("r"))
    first = staged(found.groupBy("component").agg(F.min(order).alias("first")), "first")
    out = found.join(first.hint("shuffle_merge"), "component")
    return out.select("row_id", "doc_id", F.col("first.d").alias("class_id"), (F.col("first.r") == F.col("row_id")).alias("kept")), texts
