"""Phase of superclusters and blocks: decisions, the two-state path, errors and where they lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNTIL = (Window.unboundedPreceding, Window.currentRow)


def phase_decision(orig: Column, swap: Column, threshold: float = 0.6) -> Column:
    """0 (as is), 1 (swapped) or 2 (undecided) from the two distances; reductions are single precision."""

    def less(a: Column, b: Column) -> Column:
        return (F.lit(1.0).cast("float") - a.cast("float") / F.when(b == 0, 1).otherwise(b).cast("float")).cast("double") > threshold

    return F.when(orig == swap, 2).when(orig == 0, 0).when(swap == 0, 1).when(less(orig, swap), 0).when(less(swap, orig), 1).otherwise(2)


def phase_blocks(superclusters: DataFrame) -> DataFrame:
    """block index per contig: a new one wherever phase_set changes."""
    w = Window.partitionBy("contig").orderBy("sc_idx")
    new = F.coalesce(F.col("phase_set") != F.lag("phase_set").over(w), F.lit(True)).cast("int")
    return superclusters.withColumn("_new", new).withColumn("pb_idx", F.sum("_new").over(w.rowsBetween(*_UNTIL)) - 1).drop("_new")


def phase_path(superclusters: DataFrame, keys: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Cheapest sequence of block states: adds pb_phase, is_switch and is_flip.

    superclusters: sc_idx, sc_phase (0, 1, 2 undecided), phase_set.  Being against a decided supercluster
    costs 1, changing state costs 1, or nothing where the phase set changes; ties change.  The path is
    traced back from the cheaper end, as is on a tie.  is_switch: the state changed before this
    supercluster inside a phase set; is_flip: the state was kept, and this supercluster contradicts it.

    A change is free between phase sets, so costs start anew there, and each run of one phase set is an ordered fold of
    its own, for either state that the run behind it may begin with.  Which one that is follows from the later runs, by
    windows over what each hands on.
    """
    import numpy as np

    w = Window.partitionBy(*keys).orderBy("sc_idx")
    new = F.coalesce(F.col("phase_set") != F.lag("phase_set").over(w), F.lit(True)).cast("int")
    runs = superclusters.withColumn("_new", new).withColumns({"_run": F.sum("_new").over(w.rowsBetween(*_UNTIL)), "_end": F.lead("sc_idx").over(w).isNull()}).drop("_new")

    def fold(pdf):
        pdf = pdf.sort_values("sc_idx").reset_index(drop=True)
        sc, n, last = pdf["sc_phase"].to_numpy(), len(pdf), bool(pdf["_end"].iloc[-1])
        cost, swapped = [0, 0], np.zeros((2, n), bool)
        for i in range(n):
            here = [cost[0] + int(sc[i] == 1), cost[1] + int(sc[i] == 0)]
            step = 0 if i + 1 == n and not last else 1
            for p in (0, 1):
                stay, change = here[p], here[1 - p] + step
                swapped[p, i] = not stay < change
                cost[p] = min(stay, change)
        out = {}
        for begin in (0, 1):
            state = int(cost[1] < cost[0]) if last else begin
            path, switch, flip = np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n, bool)
            for i in range(n - 1, -1, -1):
                if swapped[state, i]:
                    if i + 1 < n:
                        switch[i + 1] = True
                    state = 1 - state
                elif sc[i] != 2 and sc[i] != state:
                    flip[i] = True
                path[i] = state
            out |= {f"_path{begin}": path, f"_switch{begin}": switch, f"_flip{begin}": flip}
        return pdf.assign(**out, _first=np.arange(n) == 0)

    more = [T.StructField(f"_{k}{b}", t) for b in (0, 1) for k, t in (("path", T.IntegerType()), ("switch", T.BooleanType()), ("flip", T.BooleanType()))]
    both = runs.groupBy(*keys, "_run").applyInPandas(fold, T.StructType(runs.schema.fields + more + [T.StructField("_first", T.BooleanType())]))
    # a run hands on a state of its own, or the one behind it, as it is or exchanged
    later = Window.partitionBy(*keys).orderBy(F.desc("sc_idx")).rowsBetween(Window.unboundedPreceding, -1)
    exchanged = (F.col("_first") & (F.col("_path0") > F.col("_path1"))).cast("int")
    both = both.withColumn("_n", F.coalesce(F.sum(exchanged).over(later), F.lit(0)))
    own = F.when(F.col("_first") & (F.col("_path0") == F.col("_path1")), (F.col("_path0") + F.col("_n")) % 2)
    rows = both.withColumn("_own", own).withColumn("_state", F.coalesce((F.last("_own", ignorenulls=True).over(later) + F.col("_n")) % 2, F.lit(0)))

    def chosen(k: str) -> Column:
        return F.when(F.col("_state") == 0, F.col(f"_{k}0")).otherwise(F.col(f"_{k}1"))

    return rows.select(*superclusters.columns, chosen("path").alias("pb_phase"), chosen("switch").alias("is_switch"), chosen("flip").alias("is_flip"))


def flip_categories(flips: DataFrame, superclusters: DataFrame, ratio: float = 0.7) -> DataFrame:
    """(category, found, n): another tool's flips and our own, by what the distances of their superclusters say.

    flips: contig, start; superclusters: contig, sc_idx, beg, end, orig_ed, swap_ed, pb_phase, flip_error.  Categories:
    none (the block's state is free of edits), flip (the other one is), and unknown_flip or unknown_none where neither is,
    by whether the other state saves at least `ratio` of the edits.  found: "flip" for flips of the other tool, each in
    the first supercluster that holds it (ends included); "none" for our own flips that hold none of them.
    Positions meet superclusters by 16 kb bins.
    """
    orig = F.col("pb_phase") == 0
    kept, other = F.when(orig, F.col("orig_ed")).otherwise(F.col("swap_ed")), F.when(orig, F.col("swap_ed")).otherwise(F.col("orig_ed"))
    saves = (1 - F.try_divide(other.cast("double"), kept)) >= ratio
    name = F.when(kept == 0, "none").when(other == 0, "flip").when(other >= kept, "unknown_none").when(saves, "unknown_flip").otherwise("unknown_none")
    sc = superclusters.select("contig", "sc_idx", "beg", "end", "flip_error", name.alias("category"))
    binned = sc.withColumn("bin", F.explode(F.sequence(F.floor(F.col("beg") / 16384), F.floor(F.col("end") / 16384))))
    points = flips.select("contig", "start", F.monotonically_increasing_id().alias("flip_id")).withColumn("bin", F.floor(F.col("start") / 16384))
    met = points.join(binned, ["contig", "bin"]).where("start >= beg and start <= end")
    theirs = met.groupBy("flip_id").agg(F.min_by("category", "sc_idx").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    ours = sc.where(F.col("flip_error") != 0).join(met.select("contig", "sc_idx").distinct(), ["contig", "sc_idx"], "left_anti").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return theirs.withColumn("found", F.lit("flip")).unionByName(ours.withColumn("found", F.lit("none"))).select("category", "found", "n")


def effective_swap(sc_phase: Column, pb_phase: Column) -> Column:
    """Whether query haplotypes are exchanged in a supercluster: its own decision, else its block's."""
    return F.when(sc_phase != 2, sc_phase == 1).otherwise(pb_phase == 1)


def flip_flag(sc_phase: Column, pb_phase: Column) -> Column:
    return (sc_phase != 2) & (sc_phase != pb_phase)


def error_intervals(path: DataFrame) -> DataFrame:
    """Where each switch or flip may have happened: between decided superclusters around it.

    path: contig, sc_idx, beg, end, sc_phase, pb_idx, is_switch, is_flip.  The search leftwards ends at the
    first supercluster, rightwards at the last, decided or not.
    """
    w = Window.partitionBy("contig").orderBy("sc_idx")
    back = Window.partitionBy("contig").orderBy(F.desc("sc_idx"))
    decided = F.col("sc_phase") != 2
    left = F.coalesce(F.last(F.when(decided, F.col("end")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    right = F.coalesce(F.last(F.when(decided, F.col("beg")), True).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.first("beg").over(back.rowsBetween(Window.unboundedPreceding, -1)))
    rows = path.withColumns({"l": left, "r": right}).withColumn("h", F.coalesce(F.when(decided, F.col("beg")).otherwise(F.col("r")), F.col("beg")))

    def part(cond: Column, start: str, stop: str, name: str) -> DataFrame:
        return rows.where(cond).select("contig", F.col(start).alias("start"), F.col(stop).alias("stop"), F.lit(name).alias("switch_type"), F.col("sc_idx").alias("supercluster"), F.col("pb_idx").alias("phase_block"))

    return (
        part(F.col("is_flip") & F.col("l").isNotNull(), "l", "beg", "FLIP_BEG")
        .unionByName(part(F.col("is_flip") & F.col("r").isNotNull(), "end", "r", "FLIP_END"))
        .unionByName(part(F.col("is_switch") & F.col("l").isNotNull(), "l", "h", "SWITCH_ERR"))
    )


def correct_segments(path: DataFrame, on_switch: bool, on_flip: bool) -> DataFrame:
    """(contig, size) of runs of superclusters between breaks: phase sets, and switches or flips if asked for.

    A flipped supercluster is a segment of its own; nothing remains after a flip of the last one.
    """
    w = Window.partitionBy("contig").orderBy("sc_idx")
    flip = F.col("is_flip") if on_flip else F.lit(False)
    rows = path.withColumn("_flip", flip)
    new = (
        F.lag("pb_idx").over(w).isNull()
        | (F.col("pb_idx") != F.lag("pb_idx").over(w))
        | (F.col("is_switch") if on_switch else F.lit(False))
        | F.col("_flip")
        | F.coalesce(F.lag("_flip").over(w), F.lit(False))
    )
    seg = rows.withColumn("_new", new.cast("int")).withColumn("seg", F.sum("_new").over(w.rowsBetween(*_UNTIL)))
    return seg.groupBy("contig", "seg").agg((F.max("end") - F.min("beg")).cast("long").alias("size")).select("contig", "size")
