import random

import numpy as np
from pyspark.sql import functions as F

from haplospark.llm.toxicity import label_model, label_model_of, mine_terms, train_toxicity


def test_copies_do_not_fill_the_sample(spark):
    rng = random.Random(5)
    texts = [(" ".join(f"w{rng.randrange(50)}" for _ in range(12)) + (" vilemark" if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(200)]
    key = {t: spark.range(1).select(F.xxhash64(F.lit(t), F.lit(2))).first()[0] for t, _ in texts[:40]}
    hot = min((t for t, toxic in texts[:40] if not toxic), key=key.get)
    rows = texts + [(hot, 0)] * 300
    model = train_toxicity(spark.createDataFrame(rows, "text string, toxic int"), sample=100)
    a, b = model.scores([b"w1 w2 w3 vilemark", b"w1 w2 w3"])
    assert b"=vilemark" in model.terms[: model.voters] and a > 0.7 > 0.3 > b


def test_rare_markers_are_mined_whatever_the_corpus(spark):
    rows = [(f"common{k % 7} filler" + (" raremark" if k < 20 else ""), 1) for k in range(4000)] + [(f"calm{k % 7} filler", 0) for k in range(8000)]
    terms, voters = mine_terms(spark.createDataFrame(rows, "text string, toxic int"))
    assert b"=raremark" in terms[:voters] and b"=filler" not in terms[:voters]


def test_label_model_of_patterns_equals_that_of_rows(spark):
    rng = np.random.default_rng(1)
    given = rng.integers(0, 2, 500)
    votes = (rng.random((500, 5)) < np.where(given[:, None] > 0, 0.5, 0.1)).astype(int)
    rows = [([i for i in range(5) if v[i]], int(g)) for v, g in zip(votes, given)]
    patterns = spark.createDataFrame(rows, "votes array<int>, toxic int").groupBy("votes", "toxic").agg(F.count(F.lit(1)).alias("n"))
    got, want = label_model_of(patterns, 5), label_model(votes, given)[1]
    assert all(np.allclose(got[k], want[k]) for k in want)
