"""Column functions of the variant model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), value worked out once also where lambdas use it."""
    return F.transform(F.array(value), body)[0]


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings."""
    n = F.least(F.length(a), F.length(b))
    first = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(n == 0, F.lit(0)).otherwise(F.coalesce(F.try_element_at(first, F.lit(1)) - 1, n))


def trimmed(ref: Column, alt: Column) -> Column:
    """struct(skip, type, ref, alt): shared ends taken off and the change classified.

    Alleles of different lengths lose their common prefix, then their common suffix; what is then empty tells an
    insertion or deletion, else the change is complex.  Alleles of one length are a SNP if they have one base or
    agree from the second base on, else complex; equal ones are a reference call.
    """
    r, a = F.length(ref), F.length(alt)

    def parts(p: Column) -> Column:
        rest_r, rest_a = F.substring(ref, p + 1, r - p), F.substring(alt, p + 1, a - p)
        s = common_prefix(F.reverse(rest_r), F.reverse(rest_a))

        def cut(n: Column) -> Column:
            left_r, left_a = F.substring(rest_r, F.lit(1), F.length(rest_r) - n), F.substring(rest_a, F.lit(1), F.length(rest_a) - n)
            kind = F.when(left_r == "", "INS").when(left_a == "", "DEL").otherwise("CPX")
            return F.struct(p.alias("skip"), kind.alias("type"), left_r.alias("ref"), left_a.alias("alt"))

        return let(s, cut)

    same = F.struct(
        F.lit(0).alias("skip"),
        F.when(ref == alt, "REF").when((r == 1) | (F.substring(ref, F.lit(2), r) == F.substring(alt, F.lit(2), a)), "SNP").otherwise("CPX").alias("type"),
        F.when(r > 0, F.when((F.substring(ref, F.lit(2), r) == F.substring(alt, F.lit(2), a)) & (ref != alt), F.substring(ref, 1, 1)).otherwise(ref)).otherwise(ref).alias("ref"),
        F.when(r > 0, F.when((F.substring(ref, F.lit(2), r) == F.substring(alt, F.lit(2), a)) & (ref != alt), F.substring(alt, 1, 1)).otherwise(alt)).otherwise(alt).alias("alt"),
    )
    return F.when(r == a, same).otherwise(let(common_prefix(ref, alt), parts))


def ref_length(type_: Column, ref: Column) -> Column:
    return F.when(type_ == "INS", 0).when(type_.isin("SNP", "REF"), 1).otherwise(F.length(ref))


def variant_size(type_: Column, ref: Column, alt: Column) -> Column:
    return F.when(type_ == "INS", F.length(alt)).when(type_ == "DEL", F.length(ref)).otherwise(1)


def size_class(type_: Column, size: Column, sv_threshold: int = 50) -> Column:
    return F.when(type_.isin("SNP", "SUB"), "SNP").when(size < sv_threshold, "INDEL").otherwise("SV")


def q_score(p_error: Column) -> Column:
    """-10 log10 of an error probability, within 0..100; 0 errors give 100."""
    return F.when(p_error <= 0, 100.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), -10 * F.log10(p_error))))
