import random
import re

import numpy as np

from haplospark.llm.common import keyed_texts
from haplospark.llm.sentence_dedup import CUT, sentence_span_dedup
from haplospark.llm.suffix_dedup import Hasher

RNG, HASHER = random.Random(11), Hasher(1 << 16)


def words(n, stops=0.0):
    return [f"w{RNG.randrange(10**6)}" + ("." if RNG.random() < stops else "") for _ in range(n)]


def pasted(passage, stops):
    """The passage behind and before other words, mid-sentence on both sides."""
    return " ".join([*words(RNG.randrange(1, 40), stops), *passage, *words(RNG.randrange(1, 40), stops)])


def test_every_repeat_of_51_words_loses_a_span(spark):
    cases = []
    for stops in (0.0, 0.01, 0.08, 0.3, 1.0):
        cases += [words(51, stops) for _ in range(60)]
    cases += [["same"] * 51, ["same"] * 300, ["a", "b"] * 26, [*words(25), "end.", *words(25)]]
    rows = []
    for k, p in enumerate(cases):
        rows += [(2 * k, pasted(p, 0.1 * (k % 3))), (2 * k + 1, pasted(p, 0.1 * (k % 3)))]
    out = {r["doc_id"]: r for r in sentence_span_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    for k, p in enumerate(cases):
        if len(set(p)) > 20:
            assert out[2 * k]["kept"] == text[2 * k]
        assert len(text[2 * k + 1].split()) - len(out[2 * k + 1]["kept"].split()) >= 20, (k, p)


def test_one_word_over_and_over_in_one_text(spark):
    text = " ".join([*words(30), *["again"] * 2320, *words(30)])
    got = sentence_span_dedup(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["kept"].split().count("again") < 40 and got["kept"].split()[:20] == text.split()[:20]


def sentences_slowly(text):
    """(begin, words) of each sentence; only the hash of a word is the operator's own."""
    raw = text.encode()
    found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    if not found:
        return []
    low = raw.lower()
    prefix = HASHER.prefix(np.frombuffer(low, np.uint8))
    h = [int(HASHER.of(prefix, np.array([a]), np.array([b]))[0]) for a, b in found]
    n = len(found)
    stop = [i == n - 1 or raw[found[i][1] - 1 : found[i][1]] in (b".", b"!", b"?") or b"\n" in raw[found[i][1] : found[i + 1][0]] for i in range(n)]
    least = [any(h[i] == min(h[a : a + CUT]) for a in range(max(0, i - CUT + 1), min(i, n - CUT) + 1)) for i in range(n)]
    ends, begin = [], 0
    for i in range(n):
        if stop[i]:
            ends += [j for j in range(begin, i) if i - begin + 1 > CUT and least[j]] + [i]
            begin = i + 1
    out, begin = [], 0
    for e in ends:
        out.append((found[begin][0] if out else 0, tuple(low[a:b] for a, b in found[begin : e + 1])))
        begin = e + 1
    return out


def kept_slowly(rows, sentences, words):
    """Texts without the sentences of all but the first place of each repeated span."""
    all_, seen, gone = {}, set(), {}
    for key in sorted(rows, key=lambda k: (k[0] is not None, k[0] or 0, k[1])):
        own = all_[key] = sentences_slowly(rows[key] or "")
        gone[key] = set()
        for i in range(len(own)):
            j = i
            while j < len(own) and (j - i < sentences or sum(len(w) for _, w in own[i:j]) < words):
                j += 1
            if j - i >= sentences and sum(len(w) for _, w in own[i:j]) >= words:
                span = tuple(w for _, w in own[i:j])
                if span in seen:
                    gone[key].update(range(i, j))
                seen.add(span)
    out = {}
    for key, text in rows.items():
        raw, own = (text or "").encode(), all_[key]
        ends = [b for b, _ in own[1:]] + [len(raw)]
        out[key] = (len(own), len(gone[key]), b"".join(raw[b:e] for i, ((b, _), e) in enumerate(zip(own, ends)) if i not in gone[key]).decode() if own else raw.decode())
    return out


def test_equals_brute_force(spark):
    rng = random.Random(31)
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "Öl", "x."]

    def prose(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", ". ", "!\n", "\n", "\t"]) for _ in range(n))

    parts = [prose(rng.randint(10, 90)) for _ in range(14)]
    rows = [(rng.choice([None, *range(30)]), "".join(rng.choice([rng.choice(parts), rng.choice(parts).upper(), prose(20)]) for _ in range(rng.randint(1, 5)))) for _ in range(60)]
    rows += [(90, None), (91, ""), (92, " \n"), (93, "same " * 200), (94, "same " * 90), (95, "one. two. three.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {(r["doc_id"], r["row_id"]): (r["n_sentences"], r["n_removed"], r["kept"]) for r in sentence_span_dedup(df).collect()}
    keyed = {(r["doc_id"], r["row_id"]): r["text"] for r in keyed_texts(df).collect()}
    assert got == kept_slowly(keyed, 3, 20) and sum(n for _, n, _ in got.values()) > 300
