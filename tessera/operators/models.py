"""Behaviour models: statistics, invariants, predictions, drift, test data."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import checkpointed
from tessera.operators.quality import hash_unit, union_all
from tessera.operators.traces import guarded_corr


def distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """M2: mean, population deviation, skewness, excess kurtosis and shape of each column, in one aggregate.

    Constant columns have no skewness or kurtosis.
    """
    def parts(k: int, c: str):
        x, varies = F.col(c).cast("double"), F.stddev_pop(c) > 0
        return [F.avg(x).alias(f"m{k}"), F.stddev_pop(x).alias(f"s{k}"), F.when(varies, F.skewness(x)).alias(f"w{k}"), F.when(varies, F.kurtosis(x)).alias(f"u{k}")]

    wide = df.agg(*[p for k, c in enumerate(columns) for p in parts(k, c)])
    rows = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"{a}{k}").alias(n) for a, n in (("m", "mean"), ("s", "stddev"), ("w", "skewness"), ("u", "kurtosis"))]) for k, c in enumerate(columns)]
    out = wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    skew, kurt = F.abs("skewness"), F.col("kurtosis")
    return out.withColumn("shape", F.when((skew < 0.5) & (F.abs(kurt) < 1), "normal").when((skew < 0.5) & (kurt <= -1), "uniform").when(skew >= 0.5, "skewed").otherwise("unknown"))


def histogram(df: DataFrame, column: str, buckets: int = 20) -> DataFrame:
    """M2: equal buckets between minimum and maximum, the last one closed."""
    ends = F.broadcast(df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi")))
    place = F.when(F.col("_lo") == F.col("_hi"), 0).otherwise(F.least(F.floor((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets), F.lit(buckets - 1)))
    return df.where(F.col(column).isNotNull()).select(column).join(ends).groupBy(place.cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def categories(df: DataFrame, column: str, most: int = 20) -> DataFrame:
    """M3: the most frequent values and their share."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)
    total = F.broadcast(df.agg(F.count("*").alias("_total")))
    return counts.join(total).select("value", "n", (F.col("n") / F.col("_total")).alias("share"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """M4: Pearson's correlation of each pair, in one aggregate; null for constants."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*[guarded_corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def equality_rates(df: DataFrame, pairs: Sequence[tuple[str, str]], least: float = 0.0) -> DataFrame:
    """M5: share of rows in which two columns are equal."""
    wide = df.agg(*[F.avg(F.col(a).eqNullSafe(F.col(b)).cast("double")).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(f"{a} = {b}").alias("invariant"), F.col(f"r{k}").alias("hold_rate")) for k, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(rows).alias("x")).select("x.*").where(F.col("hold_rate") >= least)


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """M6: least squares, and accuracy 1 - mean absolute error / largest y, in a second pass."""
    fit = df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    errors = df.select(x, y).join(F.broadcast(fit)).groupBy("slope", "intercept").agg(F.avg(F.abs(F.col(y) - F.col("slope") * F.col(x) - F.col("intercept"))).alias("mae"), F.max(y).alias("top"))
    return errors.select("slope", "intercept", (1 - F.try_divide("mae", "top")).alias("accuracy"))


def conditional_constants(df: DataFrame, given: str, output: str, least: int = 5) -> DataFrame:
    """M7: values of a category under which the output is constant."""
    total = F.broadcast(df.agg(F.count("*").alias("_total")))
    grouped = df.groupBy(F.col(given).alias("given")).agg(F.count("*").alias("n"), F.count_distinct(output).alias("outputs"), F.min(output).alias("output"))
    return grouped.join(total).withColumn("confidence", F.least(2 * F.col("n") / F.col("_total"), F.lit(0.95))).where((F.col("outputs") == 1) & (F.col("n") >= least)).select("given", "output", "n", "confidence")


def outliers(df: DataFrame, column: str, sigmas: float = 2.0) -> DataFrame:
    """M9: rows beyond so many deviations from the mean."""
    stats = F.broadcast(df.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s")))
    return df.join(stats).where(F.abs(F.col(column) - F.col("_m")) > sigmas * F.col("_s")).drop("_m", "_s")


def _column(condition: Column | str) -> Column:
    """A condition as a Column; texts are SQL."""
    return F.expr(condition) if isinstance(condition, str) else condition


def rare_values(df: DataFrame, column: str, share: float = 0.01) -> DataFrame:
    """M9: (value, n) of values that fewer than ``share`` of the rows have."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.join(counts.agg(F.sum("n").alias("_all"))).where(F.col("n") < share * F.col("_all")).select("value", "n")


def violations(df: DataFrame, invariants: dict[str, Column | str], most: float = 0.1) -> DataFrame:
    """M9: (invariant, violations, rate) of invariants that some rows, but fewer than ``most``, violate."""
    wide = df.agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(_column(c), F.lit(False))).alias(f"v{k}") for k, c in enumerate(invariants.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("invariant"), F.col(f"v{k}").alias("violations"), F.try_divide(F.col(f"v{k}"), F.col("n")).alias("rate")) for k, name in enumerate(invariants)])
    return wide.select(F.explode(rows).alias("x")).select("x.*").where((F.col("violations") > 0) & (F.col("rate") < most))


def divergence_kind(expected: Column, actual: Column, tolerance: float, confidence: Column | None = None, edge: Column | None = None) -> Column:
    """Null within the tolerance, edge_case for nulls and marked rows, tolerance_issue within ten times it, model_error where the model is unsure (under 0.7), else code_bug."""
    delta = F.abs(expected - actual)
    out = F.when(expected.isNull() & actual.isNull(), None).when(expected.isNull() | actual.isNull(), "edge_case").when(delta <= tolerance, None)
    if edge is not None:
        out = out.when(edge, "edge_case")
    out = out.when(delta <= 10 * tolerance, "tolerance_issue")
    if confidence is not None:
        out = out.when(confidence < 0.7, "model_error")
    return out.otherwise("code_bug")


def validation_run(df: DataFrame, checks: dict[str, tuple[Column, str]], alerts: dict[str, float] | None = None) -> DataFrame:
    """(check, severity, passed, failed, rate, alert): named conditions with their severity, and whether the failure rate exceeds the check's threshold."""
    wide = df.agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"p{k}") for k, (c, _) in enumerate(checks.values())])
    rows = F.array(*[
        F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"), F.col(f"p{k}").alias("passed"), (F.col("n") - F.col(f"p{k}")).alias("failed"), F.lit((alerts or {}).get(name)).cast("double").alias("limit"))
        for k, (name, (_, severity)) in enumerate(checks.items())
    ])
    out = wide.select("n", F.explode(rows).alias("x")).select("n", "x.*")
    rate = F.coalesce(F.try_divide("failed", "n"), F.lit(0.0))
    return out.select("check", "severity", "passed", "failed", rate.alias("rate"), F.coalesce(rate > F.col("limit"), F.lit(False)).alias("alert"))


def drift(baseline: DataFrame, recent: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Relative shift of the mean (over a tenth drifts) and of the cardinality (over a fifth)."""
    def stats(df: DataFrame, side: str) -> DataFrame:
        wide = df.agg(*[p for k, c in enumerate(columns) for p in (F.avg(c).alias(f"m{k}"), F.count_distinct(c).alias(f"d{k}"))])
        rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m{k}").alias(f"mean_{side}"), F.col(f"d{k}").alias(f"card_{side}")) for k, c in enumerate(columns)])
        return wide.select(F.explode(rows).alias("x")).select("x.*")

    both = stats(baseline, "a").join(stats(recent, "b"), "column_name")
    shift = F.coalesce(F.try_divide(F.abs(F.col("mean_b") - F.col("mean_a")), F.abs("mean_a")), F.lit(0.0))
    cards = F.coalesce(F.try_divide(F.abs(F.col("card_b") - F.col("card_a")), F.col("card_a").cast("double")), F.lit(0.0))
    return both.select("column_name", shift.alias("mean_shift"), cards.alias("cardinality_shift"), ((shift > 0.1) | (cards > 0.2)).alias("drifted"))


def hold_rates(baseline: DataFrame, recent: DataFrame, invariants: dict[str, Column | str], drop: float = 0.1) -> DataFrame:
    """(invariant, before, after, drifted): rates at which invariants hold; a fall by more than ``drop`` drifts."""
    def rates(df: DataFrame, side: str) -> DataFrame:
        wide = df.agg(*[F.avg(F.coalesce(_column(c), F.lit(False)).cast("double")).alias(f"r{k}") for k, c in enumerate(invariants.values())])
        return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("invariant"), F.col(f"r{k}").alias(side)) for k, n in enumerate(invariants)])).alias("x")).select("x.*")

    both = rates(baseline, "before").join(rates(recent, "after"), "invariant")
    return both.withColumn("drifted", F.col("before") - F.col("after") > drop)


def drift_score(columns: DataFrame, invariants: DataFrame) -> DataFrame:
    """One row (score, findings, retrain): the largest of the mean shifts of drifting means, cardinalities and hold rates; retrain over 0.2 or from three findings."""
    shifts = columns.agg(F.coalesce(F.avg(F.when(F.col("mean_shift") > 0.1, F.col("mean_shift"))), F.lit(0.0)).alias("a"), F.coalesce(F.avg(F.when(F.col("cardinality_shift") > 0.2, F.col("cardinality_shift"))), F.lit(0.0)).alias("b"),
                         (F.count_if(F.col("mean_shift") > 0.1) + F.count_if(F.col("cardinality_shift") > 0.2)).alias("m"))
    falls = invariants.agg(F.coalesce(F.avg(F.when(F.col("drifted"), F.col("before") - F.col("after"))), F.lit(0.0)).alias("c"), F.count_if("drifted").alias("k"))
    score, found = F.greatest("a", "b", "c"), F.col("m") + F.col("k")
    return shifts.join(falls).select(score.alias("score"), found.alias("findings"), ((score > 0.2) | (found >= 3)).alias("retrain"))


def boundary_cases(signature: DataFrame) -> DataFrame:
    """For (name, low, high, mean, stddev): the values at and around the bounds."""
    c = F.col
    rows = {
        "min": c("low"), "below-min": c("low") - 0.001, "max": c("high"), "above-max": c("high") + 0.001, "zero": F.lit(0.0), "minus-one": F.lit(-1.0),
        "mean-2s": c("mean") - 2 * c("stddev"), "mean+2s": c("mean") + 2 * c("stddev"), "beyond": c("high") * 1.1,
    }
    cases = F.array(*[F.struct(F.lit(n).alias("case"), v.cast("double").alias("value")) for n, v in rows.items()])
    return signature.select("name", F.explode(cases).alias("x")).select("name", "x.*")


def random_cases(signature: DataFrame, count: int, seed: int) -> DataFrame:
    """Seeded uniform values between the bounds; equal seeds give equal values in any partitioning."""
    draws = signature.select("*", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("k"))
    unit = hash_unit(seed, "name", "k")
    return draws.select("name", "k", (F.col("low") + unit * (F.col("high") - F.col("low"))).alias("value"))


def partition_cases(df: DataFrame, column: str, accuracy: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, case, value): the middles of the four quarters of a column, and its mean, in each group.

    Exact quarters come from running sums over counted values, which stay spread.
    """
    group = F.struct(*by) if by else F.lit(0)
    one = df.groupBy(group.alias("_g")).agg(F.min(column).alias("_low"), F.max(column).alias("_high"), F.avg(column).alias("mean"), F.count(column).alias("_all"))
    if accuracy is not None:
        middle = df.groupBy(group.alias("_g")).agg(F.percentile_approx(column, [0.25, 0.5, 0.75], accuracy).alias("_m"))
    else:
        from tessera.operators.condensation import running_sums

        counts = df.where(F.col(column).isNotNull()).groupBy(group.alias("_g"), F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
        ranked = running_sums(counts, "_g", "_v", "_n").join(one.select("_g", "_all"), "_g")
        at = lambda share: F.min(F.when(F.col("before") + F.col("_n") >= F.ceil(F.col("_all") * share), F.col("_v")))
        middle = ranked.groupBy("_g").agg(F.array(at(0.25), at(0.5), at(0.75)).alias("_m"))
    cuts = F.concat(F.array("_low"), F.coalesce("_m", F.array(F.lit(None), F.lit(None), F.lit(None))), F.array("_high"))
    one = one.join(middle, "_g", "left").select(*[F.col(f"_g.{c}").alias(c) for c in by], cuts.alias("q"), "mean")
    rows = [F.struct(F.lit(f"quarter-{k + 1}").alias("case"), ((F.col("q")[k] + F.col("q")[k + 1]) / 2).cast("double").alias("value")) for k in range(4)]
    return one.select(*by, F.explode(F.array(*rows, F.struct(F.lit("mean").alias("case"), F.col("mean").cast("double").alias("value")))).alias("x")).select(*by, "x.*")


def text_cases(longest: int = 1000) -> list[tuple[str, str]]:
    """Texts at the edges: empty, blank, very long."""
    return [("empty", ""), ("blank", "   "), ("long", "X" * longest)]


def edge_and_invariant_cases(cases: DataFrame, invariants: dict[str, Column | str], share: float = 0.1, seed: int = 3, key: str = "id") -> DataFrame:
    """Rows of ``cases`` that violate an invariant, as edge cases, and a seeded tenth of the others for each invariant that they confirm."""
    keep = hash_unit(seed, key) < share
    rows = F.array(*[F.struct(F.lit(n).alias("invariant"), F.coalesce(_column(c), F.lit(False)).alias("holds")) for n, c in invariants.items()])
    long = cases.withColumn("_x", F.explode(rows)).where(~F.col("_x.holds") | keep)
    return long.select(key, F.col("_x.invariant").alias("invariant"), F.when(F.col("_x.holds"), "invariant").otherwise("edge").alias("strategy"))


def budgets(total: int, weights: dict[str, float]) -> dict[str, int]:
    """How many cases each strategy may make: its share of the total, rounded down."""
    whole = sum(weights.values())
    return {k: int(total * w / whole) for k, w in weights.items()}


def synthesis_quality(cases: DataFrame, model: DataFrame, fields: Sequence[str], invariants: int, edges: int) -> DataFrame:
    """One row of coverages and overall quality of generated cases against what the model has seen.

    ``value_coverage`` is the mean share of the model's distinct values that
    the cases have; ``cases`` also carry strategy, invariant and edge (null
    where none). Overall: 0.4, 0.3 and 0.3 of value, invariant and edge-case
    coverage. ``diversity``: strategies of six.
    """
    seen = model.agg(*[F.count_distinct(c).alias(f"m{k}") for k, c in enumerate(fields)])
    hit = None
    for k, c in enumerate(fields):
        one = cases.select(c).distinct().join(model.select(c).distinct(), c).agg(F.count("*").alias(f"h{k}"))
        hit = one if hit is None else hit.join(one)
    shares = sum((F.coalesce(F.try_divide(F.col(f"h{k}"), F.col(f"m{k}")), F.lit(0.0)) for k in range(1, len(fields))), F.coalesce(F.try_divide("h0", "m0"), F.lit(0.0))) / len(fields)
    of = cases.agg(F.count_distinct("invariant").alias("i"), F.count_distinct("edge").alias("e"), F.count_distinct("strategy").alias("s"), F.count("*").alias("cases"))
    value, inv, edge = shares, F.least(F.lit(1.0), F.col("i") / max(invariants, 1)), F.least(F.lit(1.0), F.col("e") / max(edges, 1))
    return of.join(seen).join(hit).select("cases", value.alias("value_coverage"), inv.alias("invariant_coverage"), edge.alias("edge_coverage"), (0.4 * value + 0.3 * inv + 0.3 * edge).alias("overall"), (F.col("s") / 6).alias("diversity"))


def mutations(text: Column) -> Column:
    """Array of struct(mutation, value) of a text: reversed, in capitals, emptied, repeated, cut, padded, with a character swapped and one doubled."""
    half = (F.length(text) / 2).cast("int")
    made = {
        "reverse": F.reverse(text), "upper": F.upper(text), "empty": F.lit(""), "repeat": F.repeat(text, F.lit(3)), "cut": F.substr(text, F.lit(1), half), "pad": F.concat(F.lit(" "), text, F.lit(" ")),
        "swap": F.concat(F.substr(text, F.lit(2), F.lit(1)), F.substr(text, F.lit(1), F.lit(1)), F.substr(text, F.lit(3), F.length(text))), "double": F.concat(F.left(text, F.lit(1)), text),
    }
    return F.array(*[F.struct(F.lit(k).alias("mutation"), v.alias("value")) for k, v in made.items()])


def suite_changes(changes: DataFrame, since: int, until: int) -> DataFrame:
    """changes(suite, version, test, rule) of versions after ``since`` up to ``until``: (suite, changes, last_version)."""
    return changes.where((F.col("version") > since) & (F.col("version") <= until)).groupBy("suite").agg(F.count("*").alias("changes"), F.max("version").alias("last_version"))


def suite_coverage(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """(suite, covered, percent) of the rules that a suite's tests name."""
    known = changes.select("suite", "rule").distinct().join(rules.select("rule").distinct(), "rule").groupBy("suite").agg(F.count("*").alias("covered"))
    return known.join(rules.agg(F.count_distinct("rule").alias("_all"))).select("suite", "covered", (F.col("covered") * 100 / F.col("_all")).alias("percent"))


def model_quality(df: DataFrame, invariants: dict[str, Column | str]) -> DataFrame:
    """The mean rate at which invariants hold."""
    rates = [F.avg(F.coalesce(_column(c), F.lit(False)).cast("int")) for c in invariants.values()]
    return df.agg((sum(rates[1:], rates[0]) / len(rates)).alias("quality"))


def failure_groups(failures: DataFrame, by: Sequence[str], least: int = 2, limit: int = 10) -> DataFrame:
    """(grp, n) of the most frequent groups of failures, ``least`` or more."""
    return failures.groupBy(F.concat_ws(":", *by).alias("grp")).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "grp").limit(limit)


def golden_dataset(cases: DataFrame, inputs: Sequence[str], priority: str, key: str) -> DataFrame:
    """One case for each distinct input, that of the highest priority."""
    hashed = cases.withColumn("input_hash", F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in inputs]).cast("binary")))
    return hashed.groupBy("input_hash").agg(F.max_by(key, F.struct(F.col(priority), -F.col(key))).alias(key), F.count("*").alias("replaced"))


def anonymized(column: Column, method: str) -> Column:
    """Hash, mask (letters X, digits 9), generalize (down to a hundred) or tokenize."""
    return {
        "hash": lambda: F.substring(F.sha2(column.cast("binary"), 256), 1, 16),
        "mask": lambda: F.regexp_replace(F.regexp_replace(column, "[0-9]", "9"), "[A-Za-z]", "X"),
        "generalize": lambda: F.floor(column / 100) * 100,
        "tokenize": lambda: F.concat(F.lit("tok_"), F.substring(F.md5(column.cast("binary")), 1, 12)),
    }[method]()


def case_drift(golden: DataFrame, current: DataFrame, inputs: Sequence[str], output: str) -> DataFrame:
    """New inputs and changed outputs over the number of current cases; new inputs count once each."""
    now = current.groupBy(*inputs).agg(F.max(output).alias("now"))
    was = golden.groupBy(*inputs).agg(F.max(output).alias("was"), F.lit(True).alias("known"))
    joined = now.join(was, list(inputs), "left")
    changed = F.coalesce(F.col("known") & ~F.col("now").eqNullSafe(F.col("was")), F.lit(False))
    return joined.agg(F.count("*").alias("cases"), F.count_if(F.col("known").isNull()).alias("new_inputs"), F.count_if(changed).alias("changed")).select(
        "*", F.coalesce(F.try_divide(F.col("new_inputs") + F.col("changed"), F.col("cases")), F.lit(0.0)).alias("drift")
    )


def stratified(cases: DataFrame, by: Sequence[str], key: str, each: int, seed: int = 1) -> DataFrame:
    """A diverse selection: so many cases of every stratum, by seeded hash."""
    drawn = cases.withColumn("_u", hash_unit(seed, key))
    return drawn.withColumn("_r", F.expr(f"row_number() OVER (PARTITION BY {', '.join(by)} ORDER BY _u, {key})")).where(F.col("_r") <= each).drop("_r", "_u")


# Fixed values of the survey: ranks of priorities.
PRIORITY_RANKS = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def diverse_selection(cases: DataFrame, key: str, fields: Sequence[str], priority: str, count: int, bias: float = 0.5, pulled: int = 1000, cut=checkpointed) -> DataFrame:
    """``count`` of ``cases``: the first by priority, then one by one the case that differs most from those selected.

    A share of 1 - ``bias`` is taken by priority (critical to low, then by
    ``key``); of the others, those whose fields all equal a selected case's are
    left out. Two cases differ in the fields with different values (nulls are a
    value); of equally different ones the first by priority is taken.

    What a case differs by follows from how many of the selected have each of
    its values, so no cases meet in pairs. Such counts only grow: a round
    ranks all cases by them once and brings the ``pulled`` best; as long as the
    best of these, with counts kept up, is no worse than the last of them was,
    no other case can be better. The driver holds ``pulled`` cases and the
    counts of the selected ones; ``count`` is a size that the caller asks for.
    """
    rank = F.lit(0)
    for name, value in PRIORITY_RANKS.items():
        rank = F.when(F.col(priority) == name, value).otherwise(rank)
    values = [F.coalesce(F.col(f).cast("string"), F.lit("\x00")).alias(f"_v{k}") for k, f in enumerate(fields)]
    names = [f"_v{k}" for k in range(len(fields))]
    ranked = cut(cases.select(F.col(key).alias("_key"), (-rank).alias("_rank"), *values))
    order = ["_rank", "_key"]
    first = ranked.orderBy(*order).limit(count + 1).collect()
    if len(first) <= count:
        return cases
    chosen = first[: math.floor(count * (1 - bias))]
    spark = cases.sparkSession
    rest = ranked
    if chosen:
        rest = cut(ranked.join(F.broadcast(spark.createDataFrame(chosen, ranked.schema).select(*names).distinct()), names, "left_anti"))  # count rows at most
    seen = [Counter(r[v] for r in chosen) for v in names]
    cost = lambda r: sum(c[r[v]] for c, v in zip(seen, names, strict=True))
    while len(chosen) < count:
        asked = rest
        for k, v in enumerate(names):  # as many rows as cases are selected, at most
            counts = spark.createDataFrame(list(seen[k].items()) or [("", 0)], f"{v} string, _c{k} long")
            asked = asked.join(F.broadcast(counts), v, "left")
        total = sum([F.coalesce(F.col(f"_c{k}"), F.lit(0)) for k in range(len(names))], F.lit(0))
        taken = spark.createDataFrame([(r["_key"],) for r in chosen], ranked.select("_key").schema)
        asked = asked.join(F.broadcast(taken), "_key", "left_anti").withColumn("_cost", total)
        best = asked.orderBy("_cost", *order).limit(pulled).collect()
        if not best:
            break
        last = best[-1]
        bound = (last["_cost"], last["_rank"], last["_key"])
        while best and len(chosen) < count:
            pick = min(best, key=lambda r: (cost(r), r["_rank"], r["_key"]))
            if (cost(pick), pick["_rank"], pick["_key"]) > bound:
                break
            chosen.append(pick)
            best.remove(pick)
            for c, v in zip(seen, names, strict=True):
                c[pick[v]] += 1
    picked = spark.createDataFrame([(r["_key"],) for r in chosen], ranked.select("_key").schema).withColumnRenamed("_key", key)
    return cases.join(F.broadcast(picked), key, "left_semi")


# Fixed values of the survey: categories of symbolic inputs and properties of property-based ones, by bounds that may be missing.
SYMBOLIC = ("low", "high", "zero", "middle", "outside")
PROPERTIES = ("positive", "negative", "zero", "large", "small")


def symbolic_cases(signature: DataFrame) -> DataFrame:
    """(name, case, value) for (name, low, high): a bound each, zero, the middle, and a value outside."""
    low, high = F.coalesce("low", F.lit(0.0)), F.coalesce("high", F.lit(1000.0))
    outside = F.when(F.coalesce(F.col("low"), F.lit(0.0)) != 0, F.when(F.col("low") > 0, -1.0).otherwise(F.coalesce("high", F.lit(0.0)) + 1)).otherwise(F.coalesce("high", F.lit(0.0)) + 1)
    values = (low, high, F.lit(0.0), low + (high - low) / 2, outside)
    return signature.select("name", F.explode(F.array(*[F.struct(F.lit(c).alias("case"), v.alias("value")) for c, v in zip(SYMBOLIC, values, strict=True)])).alias("x")).select("name", "x.*")


def property_cases(signature: DataFrame) -> DataFrame:
    """(name, property, value) for (name, low, high): the largest magnitude above and below zero, zero, and the bounds."""
    large = float((1 << 53) - 1) / 2
    values = (F.abs(F.coalesce("high", F.lit(100.0))), -F.abs(F.coalesce("low", F.lit(100.0))), F.lit(0.0), F.coalesce("high", F.lit(large)), F.coalesce("low", F.lit(-large)))
    return signature.select("name", F.explode(F.array(*[F.struct(F.lit(c).alias("property"), v.alias("value")) for c, v in zip(PROPERTIES, values, strict=True)])).alias("x")).select("name", "x.*")


#: Which side of its value a comparison holds on: below, above, and whether on the value itself.
SIDES = {"greater_than": (False, False, True), "greater_or_equal": (False, True, True), "less_than": (True, False, False), "less_or_equal": (True, True, False), "equals": (False, True, False), "not_equals": (True, False, True)}


def _settings(rule: dict, wanted: bool, step: float) -> list[dict[str, tuple[float, float]]]:
    """Boxes (field to interval) on which the whole of ``rule`` is ``wanted``; alternatives are boxes of their own."""
    if "not" in rule:
        return _settings(rule["not"], not wanted, step)
    if "all" in rule or "any" in rule:
        parts = rule.get("all", rule.get("any"))
        if ("all" in rule) != wanted:  # one part decides
            return [box for p in parts for box in _settings(p, wanted, step)]
        boxes: list[dict] = [{}]
        for p in parts:
            boxes = [m for a in boxes for b in _settings(p, wanted, step) if (m := _both(a, b)) is not None]
        return boxes
    below, on, above = SIDES[rule["operator"]]
    v, f, inf = float(rule["value"]), rule["field"], math.inf
    sides = [(below, (-inf, v - step)), (on, (v, v)), (above, (v + step, inf))]
    return [{f: interval} for holds, interval in sides if holds == wanted]


def _both(a: dict, b: dict) -> dict | None:
    """Where both boxes hold, if anywhere."""
    out = dict(a)
    for f, (low, high) in b.items():
        was = out.get(f, (-math.inf, math.inf))
        out[f] = (max(was[0], low), min(was[1], high))
        if out[f][0] > out[f][1]:
            return None
    return out


def branch_boxes(rule: dict, step: float = 1.0) -> list[tuple[int, str, dict]]:
    """(leaf, side, box): for each comparison of a condition tree, below, on and above its value, the intervals of other fields where it alone decides.

    Intervals are propagated down the tree: where a comparison stands in an
    ``all``, its siblings must hold, in an ``any`` they must not. Sides that
    cannot be reached so are left out.
    """
    out, count = [], 0

    def visit(node: dict, boxes: list[dict]) -> None:
        nonlocal count
        if "not" in node:
            visit(node["not"], boxes)
        elif "all" in node or "any" in node:
            parts = node.get("all", node.get("any"))
            for i, part in enumerate(parts):
                here = boxes
                for j, other in enumerate(parts):
                    if j != i:
                        here = [m for a in here for b in _settings(other, "all" in node, step) if (m := _both(a, b)) is not None]
                visit(part, here)
        else:
            v, leaf = float(node["value"]), count
            count += 1
            for side, interval in (("below", (v - step, v - step)), ("on", (v, v)), ("above", (v + step, v + step))):
                box = next((m for a in boxes if (m := _both(a, {node["field"]: interval})) is not None), None)
                if box is not None:
                    out.append((leaf, side, box))

    visit(rule, [{}])
    return out


def branch_cases(rule: dict, signature: DataFrame, fields: Sequence[str], step: float = 1.0) -> DataFrame:
    """(leaf, side, each field, outcome): inputs on either side of each branch of ``rule``, with what it says of them.

    Other fields take the value of their interval next to the middle of what
    ``signature(name, low, high)`` has seen, so inputs are as usual as the
    branch allows. The tree is configuration; the bounds are counted by Spark.
    """
    from tessera.operators.mining import compile_condition

    spark = signature.sparkSession
    rows = [(leaf, side, f, box.get(f, (None, None))[0], box.get(f, (None, None))[1]) for leaf, side, box in branch_boxes(rule, step) for f in fields]
    rows = [(a, b, f, None if low in (None, -math.inf) else low, None if high in (None, math.inf) else high) for a, b, f, low, high in rows]
    asked = spark.createDataFrame(rows, "leaf int, side string, name string, _low double, _high double")
    usual = (F.col("low") + F.col("high")) / 2
    value = F.least(F.greatest(usual, F.coalesce("_low", usual)), F.coalesce("_high", F.greatest(usual, F.coalesce("_low", usual))))
    filled = F.broadcast(asked).join(signature, "name").groupBy("leaf", "side").pivot("name", list(fields)).agg(F.first(value))
    return filled.withColumn("outcome", compile_condition(rule))


def shrunk(value, fails, rounds: int = 1000):
    """A smaller failing input than ``value``, by halving: numbers towards 0, texts and lists to a half, dicts field by field.

    ``fails(value)`` tells whether the property fails. Single cases are small,
    so this runs where it is called.
    """
    for _ in range(rounds):
        smaller = next((c for c in _halves(value) if c != value and fails(c)), None)
        if smaller is None:
            return value
        value = smaller
    return value


def _halves(value):
    if isinstance(value, bool):
        return [False]
    if isinstance(value, int):
        return [0, value // 2 if value > 0 else -(-value // 2), value - 1 if value > 0 else value + 1]
    if isinstance(value, float):
        return [0.0, float(int(value)), value / 2]
    if isinstance(value, (str, list)):
        half = len(value) // 2
        return [value[:0], value[:half], value[half:], value[:-1], value[1:]]
    if isinstance(value, dict):
        return [{**value, k: c} for k, v in value.items() for c in _halves(v)]
    return []
