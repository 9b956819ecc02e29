"""Personal data in texts by weak supervision, in DataFrame functions only.

Base spans are fixed patterns with checks.  The method adds spans: looser patterns propose candidates, and
labelers vote on each: regular expressions and checksums on its shape, gazetteers of domain endings, titles and
words, and the context before and after it.  A labeler votes yes (2), no (1) or abstains (0).  Expectation-
maximisation over the counts of vote patterns per kind (a table of fixed size, kinds x 3^labelers) estimates
how often each labeler is right and the probability of each pattern; a logistic classifier over a fixed set of
span features is then trained on these probabilities, again from counts per feature pattern, and decides.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplospark.llm.common import staged
from haplospark.llm.quality import let

# The base patterns, written so that no character is tried more often than needed.  \G and the
# look-behind start a match where a run of the first class starts, which is where its leftmost match starts.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser patterns of candidates, tried in this order at each place.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{2,63}+){1,4}+",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+\b",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])\(?0?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{3,4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9])[A-Za-z0-9_-]{20,}+",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
}
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret", "name")
ENDINGS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "us", "ch", "at", "it", "nl")
CUES = "mail|e-mail|phone|tel|call|fax|mobile|cell|contact|reach|card|visa|iban|account|konto|ssn|social|token|key|secret|password|passwd|api|auth|bearer|signed|sincerely"
AGAINST = "version|release|section|chapter|page|isbn|issn|fig|figure|table|sha1|sha256|md5|commit|license|lizenz"
BEFORE, AFTER = 24, 12
LABELERS = ("shape", "check", "gazetteer", "cue", "against", "edges", "company")


CHUNK = 256  # rows of an array that one inner fold takes


def _folded(rows: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """The items, of SQL type kind, of an ordered fold over rows: step(place, row) gives the next place, the item, and whether it stays.

    An array that grows by one is copied each time, so a plain fold costs the square of the rows; folds of CHUNK
    rows inside a fold over chunks copy little.
    """

    def chunks(x: Column) -> Column:
        count = F.greatest(F.lit(1), F.ceil(F.size(x) / CHUNK).cast("int"))
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(x, i * CHUNK + 1, CHUNK))

    def one(s: Column, r: Column) -> Column:
        place, item, stays = step(s["at"], r)
        return F.struct(place.alias("at"), F.when(stays, F.concat(s["done"], F.array(item))).otherwise(s["done"]).alias("done"))

    def inner(at: Column, c: Column) -> Column:
        return F.aggregate(c, F.struct(at.alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("done")), one)

    none = F.expr(f"named_struct('at', 0, 'done', cast(array() as array<array<{kind}>>))")
    outer = F.aggregate(let(rows, chunks), none, lambda a, c: let(inner(a["at"], c), lambda x: F.struct(x["at"].alias("at"), F.concat(a["done"], F.array(x["done"])).alias("done"))))
    return F.flatten(outer["done"])


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, value, before, after): leftmost non-overlapping matches, positions in code points.

    The text between matches gives their places; `before` and `after` reach to the next match at most.
    """

    def placed(parts: Column) -> Column:
        gaps, found = parts["gaps"], parts["found"]
        n = F.size(found)
        rows = F.zip_with(
            F.arrays_zip(F.slice(gaps, 1, n).alias("g"), F.slice(gaps, 2, n).alias("h")), found, lambda g, m: F.struct(F.length(g["g"]).alias("gap"), m.alias("value"), F.right(g["g"], F.lit(BEFORE)).alias("before"), F.left(g["h"], F.lit(AFTER)).alias("after"))
        )

        def step(at: Column, r: Column) -> tuple[Column, Column, Column]:
            start = at + r["gap"]
            return start + F.length(r["value"]), F.struct(start.alias("start"), r["value"].alias("value"), r["before"].alias("before"), r["after"].alias("after")), F.lit(True)

        return _folded(rows, "struct<start:int,value:string,before:string,after:string>", step)

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("found"))
    return let(parts, placed)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(s: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return s + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end), kind as its place in KINDS, sorted; end exclusive."""

    def of(k: int, kind: str) -> Column:
        # a cheap look for what every match holds spares texts without it
        hint = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike(r"[0-9][0-9 .-][0-9]|[0-9]\.[0-9]"))
        good = F.filter(_matches(text, BASE[kind]), lambda m: _valid(kind, m["value"]))
        spans = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), (m["start"] + F.length(m["value"])).alias("end")))
        return F.when(hint, spans).otherwise(F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)"))

    return F.sort_array(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS) if kind in BASE]))


def _kind(value: Column) -> Column:
    """Which looser pattern, as its place in KINDS, a candidate came from."""
    out = F.lit(None)
    for kind, pattern in reversed(LOOSE.items()):
        out = F.when(value.rlike(f"^(?:{pattern})$"), KINDS.index(kind)).otherwise(out)
    return out


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 2).when(no, 1).otherwise(0)


def _described(m: Column) -> Column:
    """A candidate with its votes and features, each as one number (base 3 and base 2)."""
    value, before, after = m["value"], F.lower(m["before"]), m["after"]
    digits, size = F.length(F.regexp_replace(value, "[^0-9]", "")), F.length(m["value"])
    kind = _kind(value)

    def is_(*names: str) -> Column:
        return kind.isin(*[KINDS.index(n) for n in names])

    plain = F.regexp_replace(value, "[^0-9]", "")
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    hexed = value.rlike("^[0-9a-f]{24,}$")
    ending = F.regexp_extract(F.lower(value), r"([a-z]+)$", 1).isin(*ENDINGS)
    cue = before.rlike(rf"\b(?:{CUES})\b")
    votes = {
        "shape": _vote((is_("email") & value.rlike(r"^\S+$")) | (is_("secret") & mixed & (digits * 5 >= size)) | (is_("card") & value.rlike("^[0-9]+$")) | is_("ssn", "iban", "name"), is_("secret") & ~mixed),
        "check": _vote((is_("card") & F.when(F.length(plain).between(12, 19), _luhn(plain)).otherwise(False)) | (is_("phone") & digits.between(9, 12)) | (is_("secret") & hexed), (is_("card")) | (is_("phone") & ~digits.between(9, 12))),
        "gazetteer": _vote((is_("email") & ending) | is_("name"), is_("email")),
        "cue": _vote(cue, is_("phone", "ssn")),
        "against": _vote(F.lit(False), before.rlike(rf"\b(?:{AGAINST})\b")),
        "edges": _vote(before.rlike(r"[=:(\"'<]\s*$") | (before == ""), before.rlike(r"[\p{L}\p{N}_]$") | after.rlike(r"^[\p{L}\p{N}_]")),
        "company": _vote(F.concat(before, after).rlike("@|[0-9]{6}"), F.lit(False)),
    }
    flags = [
        size >= 20,
        digits >= 9,
        digits * 2 >= size,
        value.rlike("[a-z]"),
        value.rlike("[A-Z]"),
        value.rlike(r"[ ()]"),
        before.rlike(r"[=:(\"'<]\s*$"),
        cue,
        F.when(plain == "", False).otherwise(F.when(F.length(plain).between(12, 19), _luhn(plain)).otherwise(False)),
    ]
    return F.struct(
        m["start"].alias("start"),
        kind.alias("kind"),
        (m["start"] + size).alias("end"),
        reduce(lambda a, v: a * 3 + v, [votes[k] for k in LABELERS]).alias("votes"),
        reduce(lambda a, f: a * 2 + f.cast("int"), flags, F.lit(0)).alias("features"),
    )


N_FEATURES = 9


def candidates(text: Column) -> Column:
    """Array of (start, kind, end, votes, features) of what the looser patterns find."""
    pattern = "|".join(f"(?:{p})" for p in LOOSE.values())
    found = F.filter(F.transform(_matches(text, pattern), lambda m: let(m, _described)), lambda c: c["kind"].isNotNull())
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,votes:int,features:int>>)")
    return F.when(text.rlike(r"[0-9]|@|\(at\)|\[at\]|\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame)\b"), found).otherwise(none)


def _digits(number: int, base: int, n: int) -> list[int]:
    out = []
    for _ in range(n):
        number, d = divmod(number, base)
        out.append(d)
    return out[::-1]


def label_model(counts: dict[tuple[int, int], int], rounds: int = 60) -> dict[tuple[int, int], float]:
    """Expectation-maximisation: P(personal | kind, vote pattern) from counts by (kind, votes).

    One prior per kind, one rate of right votes per labeler and answer, abstentions ignored, all smoothed.
    """
    m = len(LABELERS)
    pattern = {key: _digits(key[1], 3, m) for key in counts}
    right = [[0.95, 0.95] if name == "check" else [0.7, 0.7] for name in LABELERS]  # of yes votes given personal, of no votes given not
    prior: dict[int, float] = {k: 0.5 for k, _ in counts}
    post: dict[tuple[int, int], float] = {}
    for _ in range(rounds):
        for key, votes in pattern.items():
            log = math.log(prior[key[0]] / (1 - prior[key[0]]))
            for (yes, no), v in zip(right, votes):
                if v == 2:
                    log += math.log(yes / (1 - no))
                elif v == 1:
                    log += math.log((1 - yes) / no)
            post[key] = 1 / (1 + math.exp(-max(-40.0, min(40.0, log))))
        for k in prior:
            n = sum(c for key, c in counts.items() if key[0] == k)
            prior[k] = (1 + sum(c * post[key] for key, c in counts.items() if key[0] == k)) / (2 + n)
        for j in range(m):
            hit, all_, off, none = 7.0, 10.0, 7.0, 10.0  # a labeler is right in 7 of 10 unless the data say otherwise
            for key, c in counts.items():
                v, p = pattern[key][j], post[key]
                if v:
                    all_, none = all_ + c * p, none + c * (1 - p)
                    hit, off = hit + c * p * (v == 2), off + c * (1 - p) * (v == 1)
            least = 0.95 if LABELERS[j] == "check" else 0.5  # a checksum is arithmetic; others are at least no worse than chance
            right[j] = [min(0.99, max(least, hit / all_)), min(0.99, max(least, off / none))]
    return post


def span_classifier(soft: dict[tuple[int, int], tuple[float, float]], rounds: int = 400) -> list[float]:
    """Logistic weights (kinds, then features) from {(kind, features): (sum of probabilities, number)}."""
    rows = [([float(k == i) for i in range(len(KINDS))] + [float(b) for b in _digits(f, 2, N_FEATURES)], p, n) for (k, f), (p, n) in sorted(soft.items())]
    total = sum(n for _, _, n in rows) or 1.0
    w = [0.0] * (len(KINDS) + N_FEATURES)
    for _ in range(rounds):
        grad = [0.0] * len(w)
        for x, p, n in rows:
            z = sum(a * b for a, b in zip(w, x))
            e = (p - n / (1 + math.exp(-max(-40.0, min(40.0, z))))) / total
            grad = [g + e * a for g, a in zip(grad, x)]
        w = [a + 2.0 * (g - 1e-4 * a) for a, g in zip(w, grad)]
    return w


def _accepted(spans: Column, weights: list[float]) -> Column:
    def score(c: Column) -> Column:
        z = F.element_at(F.array(*[F.lit(x) for x in weights[: len(KINDS)]]), c["kind"] + 1)
        for j, w in enumerate(weights[len(KINDS) :]):
            z = z + F.shiftright(c["features"], N_FEATURES - 1 - j).bitwiseAND(1) * F.lit(w)
        return z

    return F.filter(spans, lambda c: score(c) >= 0)


def find_personal_data(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """All spans of every text: doc (the row as one struct, without the text unless keep_text), base, spans.

    base and spans are arrays of (start, kind, end) in code points, sorted; kind indexes KINDS; spans holds the
    base spans and the added ones that overlap neither these nor each other.  Null and empty texts have
    no spans; rows are treated each by itself, so ids may be null or repeat; with no candidates nothing is
    added; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = [c for c in docs.columns if keep_text or c != text_col]
    doc = F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc")
    found = staged(docs.select(doc, base_spans(text).alias("base"), candidates(text).alias("proposed")), "spans")
    each = found.select(F.explode("proposed").alias("c")).select("c.*")
    counts = {(r["kind"], r["votes"]): r["n"] for r in each.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    post = label_model(counts)
    weights = [0.0] * (len(KINDS) + N_FEATURES)
    if post:
        spark = docs.sparkSession
        table = spark.createDataFrame([(k, v, p) for (k, v), p in post.items()], "kind int, votes int, p double")
        soft = each.join(F.broadcast(table), ["kind", "votes"]).groupBy("kind", "features").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("n")).collect()
        weights = span_classifier({(r["kind"], r["features"]): (r["p"], r["n"]) for r in soft})
    else:
        weights[0] = -1.0

    def marked(spans: Column, own: bool) -> Column:
        return F.transform(spans, lambda c: F.struct(c["start"].alias("start"), F.lit(not own).alias("new"), c["kind"].alias("kind"), c["end"].alias("end")))

    # by place: an added span begins where all base spans before it have ended, and ends where the next one begins
    both = F.sort_array(F.concat(marked(F.col("base"), True), marked(_accepted(F.col("proposed"), weights), False)))

    def ahead(end: Column, x: Column) -> tuple[Column, Column, Column]:
        return F.when(x["new"], end).otherwise(F.greatest(end, x["end"])), x, ~x["new"] | (end <= x["start"])

    def back(next_: Column, x: Column) -> tuple[Column, Column, Column]:  # places count downwards from 0
        return F.when(x["new"], next_).otherwise(-x["start"] - 1), x, ~x["new"] | (next_ == 0) | (x["end"] <= -next_ - 1)

    kind = "struct<start:int,new:boolean,kind:int,end:int>"
    free = _folded(F.reverse(_folded(both, kind, ahead)), kind, back)
    spans = F.transform(free, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return found.select("doc", "base", F.when(F.size("proposed") > 0, F.sort_array(spans)).otherwise(F.col("base")).alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; of spans that overlap the first counts."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def build(s: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(s, lambda x: x["end"]))
        parts = F.zip_with(s, F.slice(ends, 1, F.size(s)), lambda x, e: F.concat(F.substring(text, e + 1, x["start"] - e), F.element_at(names, x["kind"] + 1)))
        last = F.element_at(ends, -1)
        return F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text) - last))

    def step(end: Column, x: Column) -> tuple[Column, Column, Column]:
        apart = end <= x["start"]
        return F.when(apart, x["end"]).otherwise(end), x, apart

    return F.when(F.size(spans) > 0, let(_folded(spans, "struct<start:int,kind:int,end:int>", step), build)).otherwise(text)
