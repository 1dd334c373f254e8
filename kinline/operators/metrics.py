"""Evaluation of predicted pairs against the truth, in the three conventions for empty sides.

======================  ============  =============  ===========
precision/recall/F0.5   ``macro``     ``rule``       ``zero``
======================  ============  =============  ===========
neither side            1 / 1 / 1     1 / 1 / 1      0 / 0 / 0
predictions only        0 / 1 / 0     0 / 0 / 0      0 / 0 / 0
truth only              1 / 0 / 0     0 / 0 / 0      0 / 0 / 0
======================  ============  =============  ===========
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinline.operators.keyed_pass import CAND, S1

EMPTY = {"macro": ((1, 1, 1), (0, 1, 0), (1, 0, 0)), "rule": ((1, 1, 1), (0, 0, 0), (0, 0, 0)), "zero": ((0, 0, 0), (0, 0, 0), (0, 0, 0))}


def entity_counts(universe: DataFrame, predicted: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(s1, n_pred, n_true, tp) of every entity of ``universe`` (and every value of ``by``, columns of universe and predictions)."""
    by = by or []
    hits = predicted.select(*by, S1, CAND).distinct().join(truth.select(S1, CAND, F.lit(1).alias("hit")).distinct(), [S1, CAND], "left")
    p = hits.groupBy(*by, S1).agg(F.count("*").alias("n_pred"), F.count("hit").alias("tp"))
    t = truth.select(S1, CAND).distinct().groupBy(S1).agg(F.count("*").alias("n_true"))
    return universe.join(p, [*by, S1], "left").join(t, S1, "left").fillna(0, ["n_pred", "tp", "n_true"])


def scores(convention: str) -> dict[str, Column]:
    p, t, tp = F.col("n_pred"), F.col("n_true"), F.col("tp")
    neither, only_pred, only_true = EMPTY[convention]
    pr, rc = F.try_divide(tp, p), F.try_divide(tp, t)
    f = lambda beta2: F.when(tp > 0, (1 + beta2) * pr * rc / (beta2 * pr + rc)).otherwise(0.0)
    case = lambda i, x: F.when((p == 0) & (t == 0), float(neither[i])).when(t == 0, float(only_pred[i])).when(p == 0, float(only_true[i])).otherwise(x)
    return {"precision": case(0, pr), "recall": case(1, rc), "f05": case(2, f(0.25)), "f1": case(2, f(1.0))}


def macro_metrics(counts: DataFrame, convention: str = "macro", by: list[str] | None = None) -> DataFrame:
    s = scores(convention)
    return counts.groupBy(*(by or [])).agg(*[F.round(F.avg(c), 6).alias(f"macro_{n}") for n, c in s.items()], F.sum("n_pred").alias("predicted_pairs"), F.count("*").alias("entities"))


def sweep(universe: DataFrame, scored: DataFrame, truth: DataFrame, thresholds: list[float], convention: str = "macro") -> DataFrame:
    """Macro metrics at each threshold (inclusive); a pair counts at every threshold that its probability reaches.

    A pair is counted once, by the number of thresholds that it reaches; the counts of an entity at all thresholds are
    arrays of one row. Only those rows are spread by threshold, after all shuffles of pairs.
    """
    grid = sorted(thresholds)
    level = F.size(F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: F.col("probability") >= t))
    pairs = scored.groupBy(S1, CAND).agg(F.max(level).alias("level"))
    hits = pairs.join(truth.select(S1, CAND, F.lit(1).alias("hit")).distinct(), [S1, CAND], "left")
    at = lambda x: F.array(*[F.sum(F.when(F.col("level") > i, x).otherwise(0)) for i in range(len(grid))])
    counts = hits.groupBy(S1).agg(at(F.lit(1)).alias("p"), at(F.coalesce("hit", F.lit(0))).alias("t"))
    n_true = truth.select(S1, CAND).distinct().groupBy(S1).agg(F.count("*").alias("n_true"))
    none = F.array_repeat(F.lit(0).cast("long"), len(grid))
    every = universe.select(S1).join(counts, S1, "left").join(n_true, S1, "left").select(S1, F.coalesce("n_true", F.lit(0)).alias("n_true"), F.coalesce("p", none).alias("n_pred"), F.coalesce("t", none).alias("tp"))
    spread = every.select("n_true", F.explode(F.arrays_zip(F.array(*[F.lit(t) for t in grid]).alias("threshold"), "n_pred", "tp")).alias("x")).select("n_true", "x.*")
    return macro_metrics(spread, convention, ["threshold"])


def best_threshold(swept: DataFrame) -> DataFrame:
    return swept.orderBy(F.desc("macro_f05"), "threshold").limit(1)


# The coarse grid, and the reach, step and bounds of the fine one.
COARSE = [round(0.5 + 0.05 * i, 2) for i in range(10)]
FINE = [round(0.5 + 0.01 * i, 2) for i in range(50)]
REACH = 0.05


def refined_sweep(universe: DataFrame, scored: DataFrame, truth: DataFrame, convention: str = "zero") -> DataFrame:
    """The fine grid around the best threshold of the coarse one; both come from one sweep, of at most 50 rows."""
    swept = sweep(universe, scored, truth, FINE, convention)
    coarse = F.when(F.col("threshold").isin(COARSE), F.struct("macro_f05", (-F.col("threshold")).alias("t")))
    best = -F.max(coarse).over(Window.partitionBy())["t"]
    return swept.withColumn("best", best).filter(F.abs(F.col("threshold") - F.col("best")) <= REACH + 1e-9).drop("best")


def rule_report(counts: DataFrame) -> DataFrame:
    """One row of coverage, ambiguity, macro scores and match counts."""
    s = scores("rule")
    n, matched = F.count("*"), F.count_if(F.col("n_pred") > 0)
    has, many = F.col("n_true") > 0, F.col("n_true") > 1
    exact = (F.col("tp") == F.col("n_true")) & (F.col("tp") == F.col("n_pred"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return counts.agg(
        n.alias("s1_entities"),
        matched.alias("coverage_count"),
        ratio(100 * matched, n).alias("coverage_pct"),
        F.count_if(F.col("n_pred") > 1).alias("ambiguous_count"),
        ratio(100 * F.count_if(F.col("n_pred") > 1), n).alias("ambiguous_pct_total"),
        ratio(100 * F.count_if(F.col("n_pred") > 1), matched).alias("ambiguous_pct_matched"),
        F.coalesce(F.max("n_pred"), F.lit(0)).alias("max_candidates"),
        ratio(F.sum("n_pred"), matched).alias("mean_candidates_matched"),
        *[F.round(F.coalesce(F.avg(s[k]), F.lit(0.0)), 6).alias(f"macro_{k}") for k in ("precision", "recall", "f05")],
        *[F.round(F.coalesce(F.avg(F.when(has, s[k])), F.lit(0.0)), 6).alias(f"pos_macro_{k}") for k in ("precision", "recall", "f05")],
        F.count_if(~has).alias("singleton_count"),
        F.count_if(~has & (F.col("n_pred") > 0)).alias("singleton_fp_count"),
        ratio(F.count_if(~has & (F.col("n_pred") > 0)), F.count_if(~has)).alias("singleton_fp_rate"),
        F.count_if(exact).alias("exact_match_count"),
        F.count_if(many).alias("multi_match_truth_count"),
        F.count_if(many & ~exact & (F.col("tp") > 0)).alias("partially_correct_multi"),
        F.count_if(many & exact).alias("completely_correct_multi"),
    )


def blocking_report(universe: DataFrame, candidates: DataFrame, truth: DataFrame, n_targets: DataFrame) -> DataFrame:
    """Recall, candidates for each anchor, complete and zero coverage, and the reduction of the pair space."""
    counts = entity_counts(universe, candidates, truth)
    sizes = counts.agg(F.count("*").alias("n1"), F.sum("n_pred").alias("total_candidates"), F.sum("tp").alias("tp_recovered"), F.sum("n_true").alias("true_pairs"),
        F.count_if(F.col("n_true") > 0).alias("with_truth"), F.count_if((F.col("n_true") > 0) & (F.col("tp") == F.col("n_true"))).alias("complete"), F.count_if((F.col("n_true") > 0) & (F.col("tp") == 0)).alias("zero"))
    r = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    out = sizes.crossJoin(n_targets)  # two rows of one
    return out.select("total_candidates", "tp_recovered", "true_pairs", r("tp_recovered", "true_pairs").alias("candidate_recall"), r("total_candidates", "n1").alias("mean_candidates"),
        r("complete", "with_truth").alias("complete_coverage"), r("zero", "with_truth").alias("zero_coverage"), F.round(1 - F.try_divide(F.col("total_candidates"), F.col("n1") * F.col("n2")), 6).alias("reduction_ratio"))


def incremental_recall(found: DataFrame, truth: DataFrame, order: dict[str, int]) -> DataFrame:
    """For each pass in order: truths that it finds first, and all found so far. ``found``: (s1, candidate, pass_order)."""
    first = found.join(truth, [S1, CAND], "left_semi").groupBy(S1, CAND).agg(F.min("pass_order").alias("pass_order"))
    names = F.create_map(*[F.lit(x) for n, i in order.items() for x in (i, n)])
    passes = found.groupBy("pass_order").agg(F.count("*").alias("pairs"))
    out = passes.join(first.groupBy("pass_order").agg(F.count("*").alias("new_truths")), "pass_order", "left").fillna(0, ["new_truths"])
    total = F.sum("new_truths").over(Window.orderBy("pass_order").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # one row for each pass
    return out.select("pass_order", names[F.col("pass_order")].alias("pass_name"), "pairs", "new_truths", total.alias("found_so_far"))


def failure_modes(scored: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    """(s1, candidate, mode) of each truth: not_blocked, out_ranked (another candidate scores higher), below_threshold or accepted."""
    top = scored.groupBy(S1).agg(F.max("probability").alias("top"))
    x = truth.join(scored.select(S1, CAND, "probability"), [S1, CAND], "left").join(top, S1, "left")
    mode = F.when(F.col("probability").isNull(), "not_blocked").when(F.col("top") > F.col("probability"), "out_ranked").when(F.col("probability") < threshold, "below_threshold").otherwise("accepted")
    return x.select(S1, CAND, mode.alias("mode"))


def ablation(found: DataFrame, truth: DataFrame, names: dict[str, int]) -> DataFrame:
    """One row for each pass in order of its bit: pairs, truths, new truths, all so far, shares of all truths, and pairs for each new truth.

    ``found``: (s1, candidate, bit). A pass that finds nothing has a row as well.
    """
    truth = truth.select(S1, CAND).distinct()
    known = found.select(S1, CAND, "bit").distinct()
    hits = known.join(truth, [S1, CAND], "left_semi")
    first = hits.groupBy(S1, CAND).agg(F.min("bit").alias("bit")).groupBy("bit").agg(F.count("*").alias("new_gt"))
    passes = found.sparkSession.createDataFrame([(b, n) for n, b in names.items()], "bit int, pass_name string")
    out = passes
    for part, name in ((known, "candidates"), (hits, "gt_found")):
        out = out.join(part.groupBy("bit").agg(F.count("*").alias(name)), "bit", "left")
    out = out.join(first, "bit", "left").fillna(0, ["candidates", "gt_found", "new_gt"])
    total = F.broadcast(truth.agg(F.count("*").alias("total")))  # one row
    so_far = F.sum("new_gt").over(Window.orderBy("bit").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # one row for each pass
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.col("total")), F.lit(0.0)), 6)
    return out.withColumn("cumulative_gt", so_far).crossJoin(total).select(
        "pass_name", "candidates", "gt_found", "new_gt", "cumulative_gt", share("new_gt").alias("incremental_recall"), share("cumulative_gt").alias("cumulative_recall"),
        F.round(F.try_divide(F.col("candidates"), F.col("new_gt")), 6).alias("cand_per_new_gt"),
    )


def greedy_selection(found: DataFrame, truth: DataFrame, base: dict[str, int], new: dict[str, int], least: int = 5) -> list[tuple[str, int]]:
    """(pass, truths that it adds) of the new passes worth adding to the base ones.

    Passes are tried by the number of truths that the base lacks, most first, then by name; one is taken if it adds
    ``least`` truths or more to what the base and those before it find. Truths are counted by the set of passes that
    find them, so the driver gets one row for each such set.
    """
    hits = found.join(truth.select(S1, CAND).distinct(), [S1, CAND], "left_semi").groupBy(S1, CAND).agg(F.bit_or("bit").alias("mask"))
    counts = [(r["mask"], r["n"]) for r in hits.groupBy("mask").agg(F.count("*").alias("n")).collect()]
    taken = sum(base.values())
    adds = lambda bit: sum(n for mask, n in counts if mask & bit and not mask & taken)
    order, out = sorted(new, key=lambda p: (-adds(new[p]), p)), []
    for name in order:
        n = adds(new[name])
        if n >= least:
            out.append((name, n))
            taken |= new[name]
    return out


def pair_report(universe: DataFrame, scored: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    """Blocking and matching in one row: candidates and their precision, coverage, macro metrics of what reaches the threshold, recall from end to end."""
    truth = truth.select(S1, CAND).distinct()
    by = entity_counts(universe, scored, truth).select(S1, F.col("n_pred").alias("n_cand"), F.col("tp").alias("cand_tp"))
    kept = entity_counts(universe, scored.filter(F.col("probability") >= threshold), truth)
    x = kept.join(by, S1)
    s = scores("macro")
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(100.0 * a, b), F.lit(0.0)), 6)
    has = F.col("n_true") > 0
    n, t, c, ct, p, tp = (F.sum(v) for v in (F.lit(1), "n_true", "n_cand", "cand_tp", "n_pred", "tp"))
    return x.agg(
        c.alias("candidate_count"), F.round(c / n, 6).alias("candidates_per_s1"), ct.alias("blocking_tp"), ratio(ct, t).alias("blocking_recall"), ratio(ct, c).alias("candidate_precision"),
        ratio(F.count_if(has & (F.col("cand_tp") == F.col("n_true"))), F.count_if(has)).alias("complete_s1_pct"), ratio(F.count_if(has & (F.col("cand_tp") == 0)), F.count_if(has)).alias("zero_s1_pct"),
        p.alias("predicted_matches"), tp.alias("matching_tp"), *[F.round(F.avg(v), 6).alias(f"macro_{k}") for k, v in s.items()], ratio(tp, t).alias("end_to_end_recall"), ratio(tp, ct).alias("conditional_recall"), ratio(tp, p).alias("matching_precision"),
        F.count_if(F.col("n_pred") == 0).alias("s1_singletons"), F.count_if(F.col("n_pred") > 0).alias("s1_with_matches"),
    )


def conversion(before: DataFrame, after: DataFrame) -> DataFrame:
    """Of the gain in blocking recall the share that arrives in macro recall, in percent; 0 where blocking gained nothing. Two reports of one row each."""
    gain = lambda c: F.col(f"a.{c}") - F.col(f"b.{c}")
    both = before.alias("b").crossJoin(after.alias("a"))
    recall = 100 * gain("macro_recall")
    return both.select(gain("blocking_recall").alias("delta_blocking"), recall.alias("delta_matching")).select(
        *[F.round(c, 6).alias(c) for c in ("delta_blocking", "delta_matching")], F.round(F.when(F.col("delta_blocking") > 0, 100 * F.col("delta_matching") / F.col("delta_blocking")).otherwise(0.0), 6).alias("conversion_pct")
    )


def containment(truth: DataFrame, ents: DataFrame) -> tuple[int, int]:
    """(pairs, pairs whose ids are both known); no pair at all is an error."""
    ids = ents.select("entity_id").distinct()
    n = truth.count()
    if not n:
        raise ValueError("there is no true pair to look for")
    known = truth.join(ids.withColumnRenamed("entity_id", S1), S1, "left_semi").join(ids.withColumnRenamed("entity_id", CAND), CAND, "left_semi")
    return n, known.count()
