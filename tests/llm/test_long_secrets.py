import random

from pyspark.sql import functions as F

from haplospark.llm.pii import LOOSE, _matches


def test_a_secret_of_any_length_is_one_candidate(spark):
    rng = random.Random(2)
    tokens = ["".join(rng.choice("abcDEF0123456789") for _ in range(n)) for n in (20, 128, 129, 700)]
    tokens.append("-".join(tokens))
    rows = [(i, f"api token {t} end") for i, t in enumerate(tokens)]
    out = spark.createDataFrame(rows, "id int, text string").select("id", F.transform(_matches(F.col("text"), LOOSE["secret"]), lambda m: m["value"]).alias("found"))
    assert {r["id"]: r["found"] for r in out.collect()} == {i: [t] for i, t in enumerate(tokens)}
