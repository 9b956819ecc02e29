"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule compares a share in a text (symbols, repeated lines, ...) with bins.  Labelled documents are dealt into two
folds by id.  On the first one every rule learns how much a share above a bin speaks against a document (log odds,
never below zero); a document's score is the sum over rules.  The second fold certifies a cutoff of the score in
each stratum (a language): k of its n good documents score above the cutoff, and the exact binomial test of "a share of
`risk` or more does" must reject.  Cutoffs are tested in a fixed sequence, the highest first, up to the first failure,
so they need no correction among themselves; strata do, each gets delta / strata (Bonferroni).  With probability
1 - delta all certified cutoffs reject at most a share of `risk` of their stratum's good documents.  Of the certified
cutoffs the one that rejects most bad documents less good ones is taken; where none is certified (under 90 good
labelled documents, with the default numbers), scores reject nothing in that stratum.
The driver sees counts per rule and bin, and per stratum and score step: tables of fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplospark.llm.common import staged, unstage

SPACE = r"[\x20\x09-\x0D]+"
RULES = ("symbols", "dup_lines", "repeats", "capitals", "shouts", "digits")
STRATA = ("en", "de", "fr", "es")  # other languages and null form one more
BINS = 20  # of a rule, evenly over 0..1
STEPS, STEP = 40, 0.25  # cutoffs of the score: so many, so far apart
FOLDS = 3  # of the labelled documents one in so many goes to the rules' weights, the others to the cutoffs


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = F.size(words)

    def starts(windows: Column) -> Column:  # of repeated windows; windows: (hash, index) sorted
        m = F.size(windows)
        same = F.zip_with(F.slice(windows, 2, m - 1), F.slice(windows, 1, m - 1), lambda a, b: a["h"] == b["h"])
        twice = let(same, lambda s: F.zip_with(F.concat(F.array(F.lit(False)), s), F.concat(s, F.array(F.lit(False))), lambda a, b: a | b))
        hit = F.filter(F.zip_with(windows, twice, lambda w, t: F.when(t, w["i"])), lambda i: i.isNotNull())
        return F.sort_array(hit)

    def covered(at: Column) -> Column:
        gaps = F.zip_with(F.slice(at, 2, F.size(at) - 1), F.slice(at, 1, F.size(at) - 1), lambda b, a: F.least(F.lit(3), b - a))
        return F.when(F.size(at) > 0, F.aggregate(gaps, F.lit(3), lambda s, g: s + g)).otherwise(0)

    triples = F.arrays_zip(words.alias("a"), F.slice(words, 2, n).alias("b"), F.slice(words, 3, n).alias("c"))
    hashed = F.transform(F.slice(triples, 1, n - 2), lambda t, i: F.struct(F.xxhash64(t["a"], t["b"], t["c"]).alias("h"), i.alias("i")))
    return F.when(n < 4, F.lit(0)).otherwise(let(F.sort_array(hashed), lambda w: let(starts(w), covered)))


def base_measures(text: Column) -> dict[str, Column]:
    """The counts the rules use, of a text column; null counts as a text without words."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.aggregate(w, F.lit(0), lambda s, x: s + F.length(x)).alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    size = F.length(text)

    def count(chars: str) -> Column:
        return size - F.length(F.translate(text, chars, ""))

    return {
        "counts": counts,
        "by_line": by_line,
        "n_symbols": count("#*$%&|<>"),
        "n_capitals": F.length(F.regexp_replace(text, r"\P{Lu}+", "")),
        "n_shouts": count("!"),
        "n_digits": count("0123456789"),
    }


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs packed into one column `doc`, beside their measures; any names in docs are safe."""
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    m = docs.select(doc, *[c.alias(k) for k, c in base_measures(F.col(text_col)).items()])
    return m.select(
        "doc", "counts.n_words", "counts.word_chars", "n_symbols", "by_line.n_lines", "by_line.n_dup_lines", "counts.n_repeat_words", "n_capitals", "n_shouts", "n_digits"
    ).withColumns({c: F.col(c).cast("long") for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")}).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )


def rule_values() -> dict[str, Column]:
    """What each rule compares with its cutoff: a share in 0..1."""
    of = {
        "symbols": ("n_symbols", "word_chars"),
        "dup_lines": ("n_dup_lines", "n_lines"),
        "repeats": ("n_repeat_words", "n_words"),
        "capitals": ("n_capitals", "word_chars"),
        "shouts": ("n_shouts", "n_words"),
        "digits": ("n_digits", "word_chars"),
    }
    return {k: F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))) for k, (a, b) in of.items()}


def stratum(lang: Column) -> Column:
    return F.when(lang.isin(*STRATA), lang).otherwise("other")


def binomial_below(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), summed exactly."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def rule_bins() -> dict[str, Column]:
    """The last bin whose lower border each rule's value exceeds, -1 for none."""
    return {k: F.ceil(v * BINS).cast("int") - 1 for k, v in rule_values().items()}


def rule_weights(counts: dict[tuple[str, int], tuple[int, int]]) -> dict[str, list[float]]:
    """Evidence against a document by rule and bin; counts: good and bad documents of each (rule, bin)."""
    good, bad = (sum(x[q] for (r, _), x in counts.items() if r == RULES[0]) for q in (0, 1))
    if not good or not bad:
        return {r: [0.0] * BINS for r in RULES}
    share = bad / (good + bad)  # nothing seen above a bin speaks neither way
    out = {}
    for rule in RULES:
        own, g, x = [0.0] * BINS, 0, 0
        for b in range(BINS - 1, -1, -1):
            g, x = g + counts.get((rule, b), (0, 0))[0], x + counts.get((rule, b), (0, 0))[1]
            own[b] = max(0.0, math.log((x + share) / (g + 1 - share)) - math.log(share / (1 - share)))
        out[rule] = own
    return out


def score(weights: dict[str, list[float]], bins: dict[str, Column]) -> Column:
    """Evidence of all rules against a document, 0 or more."""
    of = [F.when(bins[r] < 0, 0.0).otherwise(F.try_element_at(F.array(*map(F.lit, w)), bins[r] + 1)) for r, w in weights.items() if any(w)]
    return reduce(lambda a, b: a + b, of, F.lit(0.0))


def choose_cutoffs(counts: dict[str, dict[int, tuple[int, int]]], risk: float, delta: float) -> dict[str, int]:
    """Cutoff steps by stratum; counts: good and bad documents by the last step that their score exceeds, -1 for none."""
    level, out = delta / (len(STRATA) + 1), {}
    for where, steps in counts.items():
        n, best, good, bad = sum(g for g, _ in steps.values()), 0, 0, 0
        for b in range(STEPS - 1, -1, -1):  # the greatest cutoff first: each lower one rejects more
            g, x = steps.get(b, (0, 0))
            good, bad = good + g, bad + x
            if good > risk * n or binomial_below(good, n, risk) > level:
                break  # the sequence ends at its first failure
            if bad - good > best:
                best, out[where] = bad - good, b
    return out


def step_of(score: Column) -> Column:
    """The last step that a score exceeds, -1 for none; step b stands for scores over (b + 0.5) * STEP."""
    return F.least(F.lit(STEPS), F.round(score / STEP).cast("int")) - 1


def fit_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, lang: Column | None = None) -> tuple[dict[str, list[float]], dict[str, int]]:
    """Rule weights and risk-controlled cutoffs from labels (doc_id, quality); documents that fail the base rules don't count.

    Label rows without doc_id or quality are left out; of several labels of a document the worst counts.
    """
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    lang = F.col("doc.lang") if lang is None else lang
    held = measured.where(~F.col("base_failed")).select(F.col("doc.doc_id").alias("doc_id"), stratum(lang).alias("stratum"), *[v.alias(k) for k, v in rule_bins().items()])
    held = held.join(labels, "doc_id").where("quality in (0, 1)").withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS)
    held = staged(held.groupBy("fold", "stratum", *RULES).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")), "held")
    fit, check = held.where("fold = 0"), held.where("fold <> 0")
    long = fit.select("good", "bad", F.explode(F.create_map(*[x for k in RULES for x in (F.lit(k), F.col(k))])).alias("rule", "bin"))
    rows = long.groupBy("rule", "bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()  # rules x (BINS + 1) at most
    weights = rule_weights({(r["rule"], r["bin"]): (r["good"], r["bad"]) for r in rows})
    steps = check.groupBy("stratum", step_of(score(weights, {r: F.col(r) for r in RULES})).alias("step")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()
    unstage(held)
    counts: dict[str, dict[int, tuple[int, int]]] = {}
    for r in steps:  # strata x (STEPS + 1) at most
        counts.setdefault(r["stratum"], {})[r["step"]] = (r["good"], r["bad"])
    return weights, choose_cutoffs(counts, risk, delta)


def verdict(weights: dict[str, list[float]], cutoffs: dict[str, int], lang: Column | None = None) -> Column:
    """True for documents to keep."""
    where, step = stratum(F.col("doc.lang") if lang is None else lang), step_of(score(weights, rule_bins()))
    rejected = [(where == s) & (step >= b) for s, b in sorted(cutoffs.items())]
    return ~F.col("base_failed") & ~reduce(lambda a, b: a | b, rejected, F.lit(False))


def quality_rules(docs: DataFrame, labels: DataFrame, text_col: str = "text", risk: float = 0.05, delta: float = 0.05, measures_only: bool = False) -> DataFrame:
    """Measures and verdict of every document.

    docs needs doc_id, lang and the text; labels needs doc_id and quality (1 good, 0 bad).  Returns doc (the
    whole row as one struct; without the text if measures_only), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.
    A null or empty text has no words and fails; a null lang belongs to the stratum of other languages; rows with
    null or repeated ids are judged each by itself; without labels only the base rules hold; an empty table
    gives no rows.
    """
    measured = with_measures(docs, text_col)
    if measures_only:
        measured = measured.withColumn("doc", F.col("doc").dropFields(f"`{text_col}`"))
    measured = staged(measured, "measured")
    return measured.withColumn("kept", verdict(*fit_cutoffs(measured, labels, risk, delta)))
