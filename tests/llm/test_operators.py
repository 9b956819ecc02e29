import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from haplospark.llm import queries as Q

public_tokenizers = pytest.importorskip("public_tokenizers")
RNG = random.Random(3)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, rng=RNG):
    out = []
    while len(out) < n:
        k = rng.randint(4, 12)
        s = [rng.choice(WORDS) for _ in range(k)]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return " ".join(out[:n])


BASE = [prose(n) for n in (60, 120, 300, 800)]
PASSAGE = prose(80)
EDGE = [None, "", " ", "\n\n", "a", "x" * 30_000, "äöü " * 50, "1 " * 200, "!!! ... ???", "one two three four", "<|endoftext|> 👍🏽 ﬁ \x00", "🙂" * 600]
TEXTS = [*BASE, BASE[2], BASE[1], BASE[3].replace(WORDS[5], WORDS[6]), prose(100) + " " + PASSAGE + " " + prose(50), prose(30) + "\n" + PASSAGE + "\n" + prose(200), prose(5000), *EDGE]
ODD = "doc_id long, text string, lang string, source string, n_chars long, row_id int, rest string, doc string, kept int, score int"


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with odd texts, null and repeated ids, and columns whose names operators use themselves."""
    rows = [(i, t, ["en", "de", None][i % 3], "s", len(t or ""), 1, "r", "d", 2, 3) for i, t in enumerate(TEXTS)]
    rows += [(None, BASE[0], "en", "s", 1, 1, "r", "d", 2, 3), (3, BASE[3], "en", "s", 1, 1, "r", "d", 2, 3)]
    return spark.createDataFrame(rows, ODD)


def empty(docs):
    return docs.where("false")


# --- suffix-array dedup


def cut_slowly(texts, length):
    count = collections.Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def test_suffix_dedup_equals_brute_force(docs):
    from haplospark.llm.suffix_dedup import suffix_array_dedup

    got = sorted(tuple(r) for r in suffix_array_dedup(docs).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == cut_slowly([(r["text"] or "").encode() for r in docs.collect()], 400)
    assert suffix_array_dedup(empty(docs)).count() == 0


def test_suffix_dedup_periodic_and_near_copies(spark):
    from haplospark.llm.suffix_dedup import suffix_array_dedup

    rng = random.Random(9)
    body = "".join(rng.choice("abc ") for _ in range(2600))
    texts = ["ab" * 700, "a" * 900, body, body[:1300] + "X" + body[1300:], body[200:1000], body[900:1299] + "?", "q" * 399, body[::-1], body[1900:] + "tail", "é" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in suffix_array_dedup(df).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == cut_slowly([t.encode() for t in texts], 400)


@pytest.mark.parametrize("length", [64, 200, 257])
def test_suffix_dedup_of_other_lengths(spark, length):
    from haplospark.llm.suffix_dedup import suffix_array_dedup

    rng = random.Random(length)
    body = "".join(rng.choice("abc ") for _ in range(1500))
    texts = [body, body[100 : 100 + length], body[700 : 699 + length], "x" + body[900:1300] + "y", "ab" * 200, body[1100:], None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in suffix_array_dedup(df, length).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == cut_slowly([(t or "").encode() for t in texts], length)


def test_registered_queries_leave_only_their_result(spark):
    from haplospark.llm.common import written

    before, tables = set(written()), {t.name for t in spark.catalog.listTables()}
    out = Q.queries()["op6_suffix_array_dedup"](spark, "/root/testdata/sf0.001")
    assert len(set(written()) - before) == 1 and {t.name for t in spark.catalog.listTables()} == tables and out.count() == 200


# --- packing


def test_packing(docs):
    from tokenizers import Tokenizer

    from haplospark.llm.packing import pack_documents, sequences

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = pack_documents(docs, path, with_ids=True).collect()
    model = Tokenizer.from_file(path)
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array(model.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 2048):
            own = ids[k : k + 2048].tobytes()
            want[(r["doc_id"], k // 2048, k, len(own) // 4, zlib.crc32(own))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= math.ceil(sum(r["length"] for r in rows) / 2048) + 1
    total = sequences(pack_documents(docs, path, with_ids=True)).agg(F.sum(F.length("ids")).alias("n")).first()["n"]
    assert total == 4 * sum(r["length"] for r in rows)
    assert pack_documents(empty(docs), path).count() == 0


def test_plan_is_best_fit_decreasing():
    from haplospark.llm.packing import plan_packing

    rng = random.Random(4)
    for _ in range(100):
        cap = rng.randint(3, 60)
        hist = {rng.randint(1, cap): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        bins = []
        for length in sorted(hist, reverse=True):
            for _ in range(hist[length]):
                fit = [i for i, b in enumerate(bins) if b >= length]
                if fit:
                    bins[min(fit, key=lambda i: bins[i])] -= length
                else:
                    bins.append(cap - length)
        steps, left = plan_packing(hist, cap), {}
        for length in hist:
            own = sorted((s for s in steps if s[0] == length), key=lambda s: s[1])
            for k in range(hist[length]):
                _, first, per, bin_, _ = [s for s in own if s[1] <= k][-1]
                b = bin_ + (k - first) // per
                left[b] = left.get(b, cap) - length
        assert sorted(left.values()) == sorted(bins) and min(left.values()) >= 0


# --- personal data


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum((2 * int(c) - 9 if 2 * int(c) > 9 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0


def base_spans(text):
    out = []
    for n, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((m.start(), n, m.end(), kind))
    return [(k, a, b) for a, _, b, k in sorted(out)]


PII = [
    "write a.b+c@x-y.example.com or a@b.c_d@e.f.g", "é 1.2.3.4 256.1.1.1 0001.02.3.4 1.2.3.4.5.6.7.8.9", "4539 1488 0343 6467 and 4539148803436467 4539148803436467", "call +49 (30) 1234-5678. or +1 2", "𝔸 4111-1111-1111-1111!",
    "key = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "@@ a@b a@b. .@x.y", None, "", "1" * 5000, "a" * 5000 + "@" + "b" * 5000, "x@y" + ".z" * 4000, "+" * 3000, "1.2.3." * 900, ("me@x.org " * 300),
]


def test_personal_data_base_spans_and_redaction(spark):
    from haplospark.llm.pii import find_personal_data, redacted, span_list

    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(PII)], "doc_id long, text string, base string")
    found = find_personal_data(df).select("doc.doc_id", "doc.text", span_list(F.col("base")).alias("base"), span_list(F.col("spans")).alias("spans"), redacted(F.coalesce("doc.text", F.lit("")), F.col("spans")).alias("clean"))
    for r in found.collect():
        own = [":".join(map(str, s)) for s in base_spans(r["text"] or "")]
        assert r["base"] == ",".join(own), r
        assert set(own) <= set(r["spans"].split(",")) or not own
        if r["doc_id"] == 0:
            assert r["clean"] == "write <EMAIL> or <EMAIL><EMAIL>"
        if r["doc_id"] == 4:
            assert r["clean"] == "𝔸 <CARD>!"
    assert find_personal_data(df.where("false")).count() == 0


def test_spans_of_a_text_full_of_them(spark):
    """Tens of thousands of matches in one text, and added spans against base ones, by brute force."""
    from haplospark.llm.pii import find_personal_data, redacted, span_list

    rng = random.Random(13)
    parts = ["a@b.org", "1.2.3.4", "call +49 30 1234567", "tel 030 1234 5678", "4539 1488 0343 6467", "DE44 5001 0517 5407 3249 31", "x@y.de 123-45-6789", "Frau Maria Huber", "or", "api key: 9f8a7b6c5d4e3f2a1b0c9f8a7b6c5d4e"]
    long = " ".join(rng.choice(parts) for _ in range(30_000))
    rows = [(0, long), (1, "me@x.org " * 40_000)] + [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))) for i in range(2, 60)]
    found = find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    out = found.select("doc.doc_id", "doc.text", span_list(F.col("base")).alias("base"), span_list(F.col("spans")).alias("spans"), redacted(F.col("doc.text"), F.col("spans")).alias("clean")).collect()
    added = 0
    for r in out:
        own = base_spans(r["text"])
        assert r["base"] == ",".join(":".join(map(str, x)) for x in own)
        got = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        base = {(a, b, k) for k, a, b in own}
        new = [x for x in got if x not in base]
        added += len(new)
        assert base <= set(got) and got == sorted(got, key=lambda x: x[0])
        taken = bytearray(len(r["text"]))
        for a, b, _ in base:
            taken[a:b] = b"\1" * (b - a)
        for a, b, _ in new:
            assert not any(taken[a:b])
            taken[a:b] = b"\1" * (b - a)
        clean, at = [], 0
        for a, b, k in got:
            if a >= at:
                clean += [r["text"][at:a], f"<{k.upper()}>"]
                at = b
        assert r["clean"] == "".join(clean) + r["text"][at:]
    assert added > 0 and next(r for r in out if r["doc_id"] == 1)["clean"] == "<EMAIL> " * 40_000


def test_label_model_learns_who_is_right():
    from haplospark.llm.pii import LABELERS, label_model

    rng = random.Random(8)
    counts, truth = collections.Counter(), collections.defaultdict(list)
    for _ in range(5000):
        y = rng.random() < 0.4
        votes = [0] * len(LABELERS)
        for j, right in ((0, 0.9), (2, 0.6), (3, 0.85), (5, 0.8)):
            if rng.random() < 0.8:
                votes[j] = 2 if (rng.random() < right) == y else 1
        key = (0, int("".join(map(str, votes)), 3))
        counts[key] += 1
        truth[key].append(y)
    post = label_model(counts)
    hit = sum(sum(y == (post[k] >= 0.5) for y in ys) for k, ys in truth.items())
    assert hit / 5000 > 0.88


# --- sentence spans


def test_sentence_spans(docs):
    from haplospark.llm.sentence_dedup import sentence_span_dedup

    out = {r["doc_id"]: r for r in sentence_span_dedup(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    assert out[0]["n_removed"] == 0 and out[2]["n_removed"] == 0 and out[4]["n_removed"] > 0.9 * out[4]["n_sentences"]
    first, second = (7, 8)
    assert PASSAGE[30:200] in out[first]["kept"] and PASSAGE[200:350] not in out[second]["kept"] and out[second]["n_removed"] < out[second]["n_sentences"]
    assert out[10]["kept"] == "" and out[15]["kept"] == "x" * 30_000
    assert sentence_span_dedup(empty(docs)).count() == 0


# --- near-duplicates


def shingle_set(t):
    w = t.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def test_near_duplicates(spark, docs):
    from haplospark.llm.minhash import minhash_near_dedup

    rng = random.Random(6)
    rows, family = [], {}
    for f in range(12):
        words = prose(260, rng).split()
        for c in range(6):
            w = list(words)
            for _ in range(c):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            family[len(rows)] = f
            rows.append((len(rows), " ".join(w)))
    for _ in range(40):
        family[len(rows)] = 100 + len(rows)
        rows.append((len(rows), prose(150, rng)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash_near_dedup(df)[0].collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(rows)))
    first = {}
    for i in range(len(rows)):
        first.setdefault(family[i], i)
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: first[family[i]] for i in range(len(rows))}
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)
    odd, keyed = minhash_near_dedup(docs)
    odd = odd.collect()
    assert len(odd) == docs.count() and sum(r["kept"] for r in odd) == len({r["class_id"] for r in odd if r["class_id"] is not None})
    by = {r["doc_id"]: r["class_id"] for r in odd if r["doc_id"] is not None}
    assert by[4] == 2 and by[5] == 1 and by[10] == 10 and by[11] == 11
    assert minhash_near_dedup(empty(docs))[0].count() == 0


def test_a_large_bucket_loses_no_link(spark):
    """A hot group whose members resemble the first one, and a pair that resembles only each other."""
    from haplospark.llm.minhash import minhash_near_dedup

    rng = random.Random(7)
    core, rows = prose(200, rng), []
    for i in range(40):
        w = core.split()
        w[rng.randrange(200)] = f"edit{i}"
        rows.append((i, " ".join(w)))
    half = " ".join(core.split()[:120])
    tail = prose(60, rng)
    rows += [(100, f"{half} {tail}"), (101, f"{half} {tail} end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash_near_dedup(df)[0].collect()}
    assert {got[i] for i in range(40)} == {0} and got[101] == got[100] == 100


def test_a_bucket_of_three_components_against_brute_force(spark):
    """Hundreds of members around three cores that look alike, and chains that touch no least member."""
    from haplospark.llm.common import keyed_texts
    from haplospark.llm.minhash import minhash_near_dedup, shingle_weights, shingles, similarity, weighted
    from haplospark.llm.suffix_dedup import Hasher

    rng = random.Random(12)
    core, rows = prose(120, rng).split(), []
    for f in range(3):
        own = core[: 95 - 5 * f] + prose(30, rng).split()
        for i in range(120 if f else 300):
            w = list(own)
            w[rng.randrange(len(w))] = f"edit{i}"
            rows.append((len(rows), " ".join(w)))
    w = core[:90] + prose(40, rng).split()
    for i in range(12):  # each resembles the one before
        w = list(w)
        w[rng.randrange(90, len(w))] = f"step{i}"
        rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in minhash_near_dedup(df)[0].collect()}
    weights, hasher = shingle_weights(keyed_texts(df)), Hasher(1 << 16)
    sets = [weighted(shingles([memoryview(t.encode())], hasher)[0], weights) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    assert got == dict(enumerate(root)) and 3 <= len(set(root)) <= 20


def test_consistent_weighted_samples_estimate_similarity():
    from haplospark.llm.minhash import K, Sampler, similarity

    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(0, 1 << 62, 1400).astype(np.uint64))
    a, b = np.sort(rng.choice(h, 1000, False)), np.sort(rng.choice(h, 1000, False))
    wa, wb = rng.uniform(0.5, 3, 1000).astype(np.float32), rng.uniform(0.5, 3, 1000).astype(np.float32)
    s = [Sampler().samples(x, np.log(w), np.array([0, 1000]))[0] for x, w in ((a, wa), (b, wb))]
    assert abs((s[0] == s[1]).mean() - similarity((a, wa), (b, wb))) < 4 * math.sqrt(0.25 / K)


# --- tokens


def test_pieces_against_exhaustive_search():
    from haplospark.llm.sentencepieces import Pieces

    m = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    table = dict(zip(m.keys.tolist(), m.scores.tolist()))

    def best(s):
        out = [0.0] + [-math.inf] * len(s)
        for e in range(1, len(s) + 1):
            for b in range(max(0, e - m.longest), e):
                score = table.get(int(m._key(s[b:e])), m.unknown_score if e - b == 1 else -math.inf)
                out[e] = max(out[e], out[b] + score)
        return out[-1]

    for text in ["the quick brown fox", "Ärger über Öl", "日本語 Ａé\n\n\tz", "a  b", "x" * 40, "🙂 ok"]:
        score, ids = m.encode(text)
        assert abs(score - sum(best(p) for p in m.parts(text))) < 1e-6 * abs(score)
        assert m.decode(np.array(ids)) == text


def test_pieces_against_the_library():
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    from haplospark.llm.sentencepieces import Pieces

    path = public_tokenizers.path("piece_bpe_32k.model")
    proto = pb.ModelProto()
    proto.ParseFromString(open(path, "rb").read())
    proto.trainer_spec.model_type = 1  # the same pieces and scores in unigram mode
    lib, m = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()), Pieces(path)
    score = [lib.get_score(i) for i in range(lib.get_piece_size())]
    for t in BASE[0].split(". "):
        total, ids = m.encode(t)
        assert sum(score[i] for i in ids) >= sum(score[i] for i in lib.encode(t)) - 1e-6  # the library sums in single precision


def test_pieces_round_trip(docs):
    from haplospark.llm.sentencepieces import decode_documents, encode_documents

    path = public_tokenizers.path("piece_bpe_32k.model")
    back = decode_documents(encode_documents(docs, path), path)
    want = collections.Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert collections.Counter((r["doc_id"], r["text"]) for r in back.collect()) == want
    assert all(r["round_trip"] for r in encode_documents(docs, path, check=True).collect())
    assert encode_documents(empty(docs), path).count() == 0


# --- models


def test_gru_gradients():
    from haplospark.llm.langid import WINDOW, BiGRU

    m, rng = BiGRU(["a", "b", "c"]), np.random.default_rng(0)
    x = rng.integers(0, 256, (4, WINDOW)).astype(np.uint8)
    x[:, 6:] = 0
    n, y = np.array([6, 5, 3, 6]), np.array([0, 1, 2, 1])
    _, grad = m.gradients(x, n, y)
    for k in m.w:
        at = tuple(rng.integers(0, s) for s in m.w[k].shape)
        at = (at[0], x[0, 1]) if k[0] == "E" else at
        was = m.w[k][at]
        m.w[k][at] = was + 1e-2
        up = m.gradients(x, n, y)[0]
        m.w[k][at] = was - 1e-2
        down = m.gradients(x, n, y)[0]
        m.w[k][at] = was
        assert abs((up - down) / 2e-2 - grad[k][at]) < 2e-3


def test_language_of_held_out_documents(spark, docs):
    from haplospark.llm.langid import identify_language

    out = Q.op7_gru_language_id(spark, "/root/testdata/sf0.01")
    both = out.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right = both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a")).first()["a"]
    assert right > 0.97
    none = identify_language(docs, None).collect()
    assert len(none) == docs.count() and {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}


def test_language_of_odd_texts(spark, docs):
    from haplospark.llm.langid import identify_language, train_language_model

    train = spark.createDataFrame([("en", "the and of " * 20), ("de", "über die öl " * 20), (None, "x"), ("fr", None)], "lang string, text string")
    model = train_language_model(train)
    assert model.languages == ["de", "en"]
    got = {r["doc_id"]: r for r in identify_language(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (10, 11, 12, 18)] == ["und"] * 4 and got[16]["lang_pred"] == "de" and all(0 <= r["score"] <= 1 for r in got.values())
    assert identify_language(empty(docs), model).count() == 0


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    out = Q.op10_weak_supervision_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    r = out.agg(F.count_if(F.expr("toxic = 1 and predicted = 1")).alias("tp"), F.count_if(F.expr("toxic = 0 and predicted = 1")).alias("fp"), F.count_if(F.expr("toxic = 1")).alias("n")).first()
    assert r["tp"] / r["n"] > 0.8 and r["fp"] / (r["tp"] + r["fp"]) < 0.05


def test_toxicity_of_odd_texts(spark, docs):
    from haplospark.llm.toxicity import ToxicityModel, score_toxicity, train_toxicity

    rows = [("you idiot and moron, scum", 1), ("a fine day", 0), (None, 0), ("x", None)] * 20
    model = train_toxicity(spark.createDataFrame(rows, "text string, toxic int"))
    got = {r["doc_id"]: r for r in score_toxicity(docs, model).collect()}
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[10]["predicted"] == 0
    assert model.scores([b"what an idiot, moron, scum"])[0] > 0.7 > model.scores([b"a fine day"])[0]
    none = train_toxicity(spark.createDataFrame([], "text string, toxic int"))
    assert none.scores([b""])[0] < 0.5 and isinstance(none, ToxicityModel)
    assert score_toxicity(empty(docs), model).count() == 0


# --- quality


def measures_slowly(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, t in enumerate(zip(w, w[1:], w[2:])) if tri[t] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, docs):
    from haplospark.llm.quality import quality_rules

    more = spark.createDataFrame([(900 + i, t) for i, t in enumerate(["a b c a b c", "a\na\n\nb\n \na", "#* x|y <z>", "a b c d a b c d a b " * 30, "\x0b\x0c\r a"])], "doc_id long, text string")
    both = docs.unionByName(more, allowMissingColumns=True)
    labels = spark.createDataFrame([(0, 1), (None, 1), (1, None), (3, 0), (3, 1)], "doc_id long, quality int")
    rows = quality_rules(both, labels).collect()
    assert len(rows) == both.count()
    for r in rows:
        got = tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        want = measures_slowly(r["doc"]["text"] or "")
        assert got == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])
    assert quality_rules(empty(docs), labels.where("false")).count() == 0


def test_cutoffs_hold_their_risk():
    """Over many draws of labels, a certified cutoff rejects over the risk of good documents in at most delta of them."""
    from haplospark.llm.quality import STEPS, STRATA, binomial_below, choose_cutoffs

    assert abs(binomial_below(2, 10, 0.3) - sum(math.comb(10, i) * 0.3**i * 0.7 ** (10 - i) for i in range(3))) < 1e-12
    assert choose_cutoffs({"en": {-1: (89, 9), 20: (0, 9)}, "de": {-1: (90, 9), 20: (0, 9)}}, 0.05, 0.05) == {"de": 20}
    rng, risk, delta = np.random.default_rng(5), 0.05, 0.05
    p = np.array([0.9, *np.full(STEPS, 0.1 / STEPS)])  # a step b rejects (STEPS - b) / STEPS of a tenth of good documents
    wrong = found = 0
    for _ in range(400):
        good, bad = rng.multinomial(1500, p), rng.multinomial(1500, np.full(STEPS + 1, 1 / (STEPS + 1)))
        cut = choose_cutoffs({"en": {b - 1: (int(good[b]), int(bad[b])) for b in range(STEPS + 1)}}, risk, delta)
        found += bool(cut)
        wrong += any(p[b + 1 :].sum() > risk + 1e-9 for b in cut.values())
    assert found == 400 and wrong / 400 <= delta / (len(STRATA) + 1) + 0.01


def test_quality_rejects_what_labels_call_bad(spark):
    """Over the base rules, on the small table: labelled-bad documents go, labelled-good ones stay."""
    sf = "/root/testdata/sf0.01"
    out = Q.op9_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    r = out.agg(*[F.count_if((F.col("quality") == q) & ~F.col("kept")).alias(f"gone{q}") for q in (0, 1)], *[F.count_if(F.col("quality") == q).alias(f"all{q}") for q in (0, 1)]).first()
    assert r["gone0"] >= 0.5 * r["all0"] and r["gone1"] <= 0.05 * r["all1"]


# --- neighbours


def test_neighbours(spark):
    from haplospark.llm.ann import nearest_rows

    rng = np.random.default_rng(2)
    m = rng.normal(size=(1500, 24)).astype(np.float32)
    m[200:700] = m[7]
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(2000, None), (2050, [0.0] * 24), (2100, [float("nan")] * 24), (2150, [None] * 24), (None, m[0].tolist()), (2200, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in nearest_rows(df, 50, 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 1500, 50):
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(1500), -np.round(s, 12)))[:5]
        hit += len(set(best) & {v for v, _ in got[q]})
        assert all(abs(s[v] - x) < 1e-12 for v, x in got[q]) and [x for _, x in got[q]] == sorted((x for _, x in got[q]), reverse=True)
    assert set(got) == set(range(0, 1500, 50)) and hit / 150 > 0.95
    assert [v for v, _ in got[250]] == [7, 200, 201, 202, 203]
    assert nearest_rows(df.where("false")).count() == 0
    again = df.where("vec_id in (50, 51, 52)").unionByName(df.where("vec_id in (50, 51)"))
    assert sorted((r["query_id"], r["vec_id"]) for r in nearest_rows(again, 50, 5).collect()) == [(50, 51), (50, 51), (50, 52)]
    assert [(r["query_id"], r["vec_id"]) for r in nearest_rows(df.where("vec_id in (50, 51)"), 50, 5).collect()] == [(50, 51)]


# --- pipeline


def test_pipeline(spark, docs):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and out.count() > 100
    stage, sf = docs, "/root/testdata/sf0.001"
    for name, f in corpus_pipeline.STAGES[1:-1]:
        stage = corpus_pipeline.staged(f(spark, stage, sf), name)
        assert stage.columns == docs.columns, name
        assert f(spark, empty(docs), sf).count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, docs, sf).columns == docs.columns
    texts = [r["text"] for r in stage.collect()]
    assert sum(PASSAGE[40:300] in t for t in texts) == 0 and all(t is not None for t in texts)


def test_pipeline_equals_its_parts(spark):
    """What the stages do to the small table, worked out plainly from each stage's input."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    quality, near, cut, pii, pack = (f for _, f in corpus_pipeline.STAGES)
    a = corpus_pipeline.staged(quality(spark, docs, sf), "a")
    for r in docs.join(a.select("doc_id"), "doc_id", "left_anti").collect():
        n = measures_slowly(r["text"])
        assert n[0] < 50 or 2 * n[4] > n[0] or n[2] > 0 or n[3] > 0
    b = corpus_pipeline.staged(near(spark, a, sf), "b")
    left = {r["doc_id"]: shingle_set(r["text"]) for r in b.collect()}
    ids = sorted(left)
    assert not [(i, j) for x, i in enumerate(ids) for j in ids[:x] if len(left[i] & left[j]) >= 0.83 * len(left[i] | left[j])]
    c = corpus_pipeline.staged(cut(spark, b, sf), "c")
    rows = {r["doc_id"]: r["text"] for r in c.collect()}
    want = cut_slowly([r["text"].encode() for r in b.collect()], corpus_pipeline.PASSAGE_BYTES)
    assert sum(n - gone for n, gone, _, _ in want) - sum(len(t.encode()) for t in rows.values()) <= 6 * sum(s for _, _, s, _ in want)
    d = {r["doc_id"]: r["text"] for r in pii(spark, c, sf).collect()}
    assert set(d) == set(rows) and not [t for t in d.values() if base_spans(t) and re.search(PATTERNS["email"], t)]
