"""Migration planning (D): module scores, critical paths, branches, risk factors and effort.

Modules have ``id`` and, where known, ``loc``, ``cyclomatic``, ``test_coverage``,
``doc_coverage`` (percent), ``debt_hours``, ``business_rules``, ``external_calls``,
``criticality``, ``language``, ``owners``, ``dependencies`` and ``dependents``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import checkpointed
from tessera.operators.graph import factor_score, reach, reach_along, risk_level

# Fixed values of the survey: weights of a module's score, its criticality as a number, multipliers and phases of effort.
SCORE_WEIGHTS = {"complexity": 0.3, "criticality": 0.25, "dependencies": 0.25, "risk": 0.2}
CRITICALITY_SCORE = {"low": 0.25, "medium": 0.5, "high": 0.75, "critical": 1.0}
COMPLEXITY_FACTOR = {"low": 0.8, "medium": 1.0, "high": 1.5, "veryHigh": 2.0}
LANGUAGE_FACTOR = {"cobol": 1.3, "fortran": 1.2, "vb6": 1.1, "java": 1.0, "mixed": 1.4}
CRITICALITY_FACTOR = {"low": 0.9, "medium": 1.0, "high": 1.2, "critical": 1.5}
PHASES = {"discovery": 0.05, "analysis": 0.15, "design": 0.10, "implementation": 0.40, "testing": 0.20, "deployment": 0.05, "validation": 0.05}
SEVERITY_WEIGHT = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def _lookup(key: Column, table: dict, default: float) -> Column:
    out = F.lit(float(default))
    for k, v in table.items():
        out = F.when(key == k, F.lit(float(v))).otherwise(out)
    return out


def module_score(weights: dict[str, float] = SCORE_WEIGHTS) -> Column:
    """Simple, critical, little used and loosely coupled modules first; reads ``coupling`` (0 to 10) too."""
    parts = {
        "complexity": 1 - F.least(F.col("cyclomatic") / 100, F.lit(1.0)),
        "criticality": _lookup(F.col("criticality"), CRITICALITY_SCORE, 0.5),
        "dependencies": 1 - F.least(F.col("dependents") / 20, F.lit(1.0)),
        "risk": 1 - F.col("coupling") / 10,
    }
    total = F.lit(0.0)
    for name, part in parts.items():
        total = total + part * weights[name]
    return total


def longest_paths(edges: DataFrame, nodes: DataFrame, effort: Column | str = "effort", cut=checkpointed) -> DataFrame:
    """(id, effort, dist, parent): the dearest chain of dependencies that ends in each node, itself included.

    ``edges``: source needs target. ``parent`` is the need that the chain comes
    through, of equal ones the smaller; null at its start. Nodes on or behind a
    cycle have null ``dist``. A round places all nodes whose needs are placed.
    """
    needs = cut(edges.select("source", "target").where("source <> target").distinct())
    rest = cut(nodes.select("id", F.col(effort).cast("double").alias("effort") if isinstance(effort, str) else effort.cast("double").alias("effort")))
    done = rest.limit(0).select("id", "effort", F.lit(None).cast("double").alias("dist"), F.lit(None).cast("string").alias("parent"))
    while True:
        placed = done.select(F.col("id").alias("target"), F.col("dist").alias("before"))
        waiting = needs.join(placed.select("target"), "target", "left_anti").select(F.col("source").alias("id")).distinct()
        best = needs.join(placed, "target").groupBy(F.col("source").alias("id")).agg(F.max("before").alias("before"), F.min_by("target", F.struct(-F.col("before"), "target")).alias("parent"))
        ready = rest.join(waiting, "id", "left_anti").join(best, "id", "left")
        ready = cut(ready.select("id", "effort", (F.col("effort") + F.coalesce("before", F.lit(0.0))).alias("dist"), "parent"))
        if ready.isEmpty():
            return done.unionByName(rest.select("id", "effort", F.lit(None).cast("double").alias("dist"), F.lit(None).cast("string").alias("parent")))
        done = cut(done.unionByName(ready))
        rest = cut(rest.join(ready, "id", "left_anti"))


def critical_path(paths: DataFrame) -> DataFrame:
    """The nodes of the dearest chain, (id, dist), from those of :func:`longest_paths`; of equal ends the smaller id."""
    end = paths.where("dist IS NOT NULL").orderBy(F.desc("dist"), "id").limit(1).select(F.lit("").alias("origin"), "id")
    back = paths.where("parent IS NOT NULL").select(F.col("id").alias("source"), F.col("parent").alias("target"))
    return paths.join(reach(back, end).select("id"), "id").select("id", "dist")


def parallelization(paths: DataFrame) -> DataFrame:
    """One row of the longest chain's length, all effort, and how many times shorter the chain is (1 without effort)."""
    total, longest = F.coalesce(F.sum("effort"), F.lit(0.0)), F.coalesce(F.max("dist"), F.lit(0.0))
    return paths.agg(longest.alias("path_length"), total.alias("sequential_effort"), F.when(longest > 0, total / longest).otherwise(1.0).alias("parallelization"))


def parallel_branches(edges: DataFrame, nodes: DataFrame, cut=checkpointed) -> DataFrame:
    """(branch, id): in order of id, each node not yet in a branch gathers all others in none that it neither needs nor serves.

    Nodes that find no partner are in no branch. A round costs two searches
    from one node, so this is for plans of moderate size.
    """
    steps = cut(edges.select("source", "target").distinct())
    back = steps.select(F.col("target").alias("source"), F.col("source").alias("target"))
    rest, found, branch = cut(nodes.select("id")), None, 0
    skipped = None
    while True:
        seed = rest.orderBy("id").limit(1).first()
        if seed is None:
            break
        start = rest.sparkSession.createDataFrame([("", seed["id"])], "origin string, id string")
        tied = reach_along(steps, start, cut=cut).select("id").union(reach_along(back, start, cut=cut).select("id")).distinct()
        free = rest if skipped is None else rest.unionByName(skipped)
        group = cut(free.join(tied, "id", "left_anti").select(F.lit(branch).alias("branch"), "id"))
        own = rest.where(F.col("id") == seed["id"]).select("id")
        if group.isEmpty():
            skipped = own if skipped is None else skipped.unionByName(own)
            rest = cut(rest.where(F.col("id") != seed["id"]))
            continue
        group = group.unionByName(own.select(F.lit(branch).alias("branch"), "id"))
        found = group if found is None else found.unionByName(group)
        if skipped is not None:
            skipped = cut(skipped.join(group, "id", "left_anti"))
        rest = cut(rest.join(group.select("id"), "id", "left_anti"))
        branch += 1
    return nodes.limit(0).select(F.lit(0).alias("branch"), "id") if found is None else found


#: (factor, category, condition, severity, probability, impact); severity is SQL. Fixed values of the survey.
RISK_RULES = (
    ("complexity", "technical", "cyclomatic > 50", "CASE WHEN cyclomatic > 100 THEN 'critical' ELSE 'high' END", 0.8, 0.7),
    ("complexity", "technical", "cyclomatic > 20 AND cyclomatic <= 50", "'medium'", 0.5, 0.4),
    ("size", "technical", "loc > 10000", "'high'", 0.7, 0.6),
    ("coverage", "technical", "test_coverage < 50", "CASE WHEN test_coverage < 20 THEN 'high' ELSE 'medium' END", 0.6, 0.8),
    ("debt", "technical", "debt_hours > 100", "CASE WHEN debt_hours > 200 THEN 'high' ELSE 'medium' END", 0.6, 0.5),
    ("docs", "technical", "doc_coverage < 30", "'medium'", 0.7, 0.4),
    ("critical", "business", "criticality = 'critical'", "'critical'", 0.4, 1.0),
    ("important", "business", "criticality = 'high'", "'high'", 0.5, 0.7),
    ("rules", "business", "business_rules > 50", "CASE WHEN business_rules > 100 THEN 'high' ELSE 'medium' END", 0.6, 0.7),
    ("expertise", "resource", "language IN ('cobol', 'fortran')", "'medium'", 0.7, 0.5),
    ("sme", "resource", "coalesce(owners, 0) = 0", "'medium'", 0.6, 0.6),
    ("resources", "resource", "{team} < 3", "'medium'", 0.5, 0.5),
    ("integration", "integration", "external_calls > 10", "CASE WHEN external_calls > 20 THEN 'high' ELSE 'medium' END", 0.6, 0.6),
    ("deps", "integration", "dependencies > 15", "CASE WHEN dependencies > 25 THEN 'high' ELSE 'medium' END", 0.5, 0.5),
    ("dependents", "integration", "dependents > 10", "CASE WHEN dependents > 20 THEN 'high' ELSE 'medium' END", 0.6, 0.7),
    ("schedule", "schedule", "loc / 200.0 > {days} * 0.5", "CASE WHEN loc / 200.0 > {days} THEN 'high' ELSE 'medium' END", 0.6, 0.7),
)


def risk_factors(modules: DataFrame, team: int | None = None, days: float | None = None, coupled: bool = False) -> DataFrame:
    """A row (id, factor, category, severity, score) for each rule that a module meets.

    ``team`` (available people) and ``days`` (the project's) enable the rules
    that need them. ``coupled``: modules have ``cycles`` and ``coupling``, and
    circular dependencies and a coupling over 5 count, too.
    """
    rows = []
    for name, category, condition, severity, p, i in RISK_RULES:
        if ("{team}" in condition and team is None) or ("{days}" in condition and days is None):
            continue
        test, level = (F.expr(x.format(team=team, days=days)) for x in (condition, severity))
        score = factor_score(F.lit(p), F.lit(i), _lookup(level, SEVERITY_WEIGHT, 1))
        rows.append(F.when(test, F.struct(F.lit(name).alias("factor"), F.lit(category).alias("category"), level.alias("severity"), score.alias("score"))))
    if coupled:
        high = factor_score(F.lit(0.8), F.lit(0.7), F.lit(3))
        rows.append(F.when(F.col("cycles") > 0, F.struct(F.lit("circular").alias("factor"), F.lit("integration").alias("category"), F.lit("high").alias("severity"), high.alias("score"))))
        level = F.when(F.col("coupling") > 7, "high").otherwise("medium")
        rows.append(F.when(F.col("coupling") > 5, F.struct(F.lit("coupling").alias("factor"), F.lit("integration").alias("category"), level.alias("severity"), F.col("coupling").cast("double").alias("score"))))
    return modules.select("id", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("f")).select("id", "f.*")


def module_risk(modules: DataFrame, factors: DataFrame) -> DataFrame:
    """Mean score of each module's factors (0 without) and its level.

    Scores are summed as decimals of nine places, so a mean that lies on a level's bound is
    that bound in whatever order the rows come.
    """
    mean = factors.groupBy("id").agg(F.avg(F.col("score").cast("decimal(20,9)")).cast("double").alias("score"))
    score = F.coalesce("score", F.lit(0.0))
    return modules.select("id").join(mean, "id", "left").select("id", score.alias("score"), risk_level(score).alias("level"))


def complexity_class(cyclomatic: Column) -> Column:
    return F.when(cyclomatic <= 10, "low").when(cyclomatic <= 20, "medium").when(cyclomatic <= 50, "high").otherwise("veryHigh")


def phase_efforts(modules: DataFrame, per_line: float = 0.5) -> DataFrame:
    """(id, phase, days): lines at ``per_line`` hours in days of eight, by complexity, language and criticality, split over seven phases and rounded up."""
    base = F.col("loc") * per_line / 8 * _lookup(complexity_class(F.col("cyclomatic")), COMPLEXITY_FACTOR, 1) * _lookup(F.col("language"), LANGUAGE_FACTOR, 1) * _lookup(F.col("criticality"), CRITICALITY_FACTOR, 1)
    phases = F.array(*[F.struct(F.lit(name).alias("phase"), F.ceil(F.round(base * share, 9)).alias("days")) for name, share in PHASES.items()])
    return modules.select("id", F.explode(phases).alias("p")).select("id", "p.*")


def adjustments() -> Column:
    """The product of all adjustments that a module needs."""
    # Fixed values of the survey.
    rules = (("external_calls > 10", 1.2), ("doc_coverage < 30", 1.15), ("test_coverage < 50", 1.25), ("dependencies > 15", 1.1), ("business_rules > 50", 1.2), ("debt_hours > 100", 1.1))
    out = F.lit(1.0)
    for condition, factor in rules:
        out = out * F.when(F.expr(condition), factor).otherwise(1.0)
    return out


def effort(modules: DataFrame, per_line: float = 0.5) -> DataFrame:
    """(id, person_days, person_weeks, confidence) of all phases with adjustments."""
    days = phase_efforts(modules, per_line).groupBy("id").agg(F.sum("days").alias("days"))
    total = F.round(F.col("days") * adjustments(), 9)
    sure = 0.8 * F.coalesce(F.col("doc_coverage") / 100 * 0.3 + 0.7, F.lit(1.0)) * F.when(F.col("cyclomatic") > 50, 0.85).otherwise(1.0) * F.when(F.col("loc") > 10000, 0.9).otherwise(1.0)
    return modules.join(days, "id").select("id", F.ceil(total).alias("person_days"), F.ceil(total / 5).alias("person_weeks"), F.greatest(F.lit(0.3), F.least(F.lit(0.95), sure)).alias("confidence"))


# D19. Fixed values of the survey: person-days for 1000 lines by language pair, multipliers of the team, steps of complexity and integrations, shares of phases.
PAIR_DAYS = {
    "cobol-java": 15, "cobol-python": 12, "cobol-typescript": 14, "fortran-python": 10, "fortran-java": 12,
    "vb6-typescript": 8, "vb6-csharp": 6, "java-legacy-java": 5, "java-legacy-typescript": 8,
}
OTHER_PAIR_DAYS = 12
TEAM_FACTOR = {"senior": 0.8, "mid": 1.0, "junior": 1.3, "mixed": 1.1}
COMPLEXITY_STEPS, MOST_COMPLEX = ((30, 1.0), (50, 1.2), (70, 1.5)), 1.8
INTEGRATION_STEPS, MOST_INTEGRATED = ((5, 1.0), (10, 1.2), (20, 1.4)), 1.6
PHASE_SHARES = {"analysis": 0.15, "design": 0.15, "development": 0.40, "testing": 0.20, "deployment": 0.10}


def half_up(value: Column) -> Column:
    """Rounded to whole numbers, halves upward."""
    return F.floor(value + 0.5)


def _stepped(value: Column, steps: Sequence[tuple[float, float]], otherwise: float) -> Column:
    out = F.lit(otherwise)
    for bound, factor in reversed(steps):
        out = F.when(value < bound, factor).otherwise(out)
    return out


def project_complexity(projects: DataFrame) -> DataFrame:
    """``projects`` with four complexities, each at most 100, and ``overall``, their weighted mean.

    Reads ``procedure_complexity`` (mean, null without procedures),
    ``structures``, ``nested_structures``, ``tables``, ``dependencies``,
    ``files``, ``apis``, ``rules`` and ``unsure_rules`` (confidence under 0.7).
    """
    parts = {
        "code_complexity": F.coalesce(F.col("procedure_complexity"), F.lit(0.0)) * 2,
        "data_complexity": F.col("structures") * 2 + F.col("tables") * 5 + F.col("nested_structures") * 3,
        "integration_complexity": F.col("dependencies") * 3 + F.col("files") * 2 + F.col("apis") * 5,
        "rule_complexity": F.col("rules") * 2 + F.col("unsure_rules") * 5,
    }
    rated = projects.withColumns({name: F.least(F.lit(100), half_up(value)).cast("long") for name, value in parts.items()})
    weights = (0.3, 0.2, 0.25, 0.25)
    total = F.lit(0.0)
    for name, weight in zip(parts, weights, strict=True):
        total = total + F.col(name) * weight
    return rated.withColumn("overall", half_up(total))


def project_effort(rated: DataFrame) -> DataFrame:
    """``rated`` projects with whole days by phase, their total and its range: a fifth either way, three tenths from a complexity of 50 on.

    Reads ``lines``, ``pair`` (source and target language) and ``team`` too.
    """
    links = F.col("dependencies") + F.col("apis") + F.col("files")
    days = F.col("lines") / 1000 * _lookup(F.col("pair"), PAIR_DAYS, OTHER_PAIR_DAYS)
    days = days * _stepped(F.col("overall"), COMPLEXITY_STEPS, MOST_COMPLEX) * _stepped(links, INTEGRATION_STEPS, MOST_INTEGRATED) * _lookup(F.col("team"), TEAM_FACTOR, 1.0)
    phased = rated.withColumns({f"{name}_days": half_up(days * share) for name, share in PHASE_SHARES.items()})
    total = phased.withColumn("total_days", sum([F.col(f"{name}_days") for name in PHASE_SHARES], F.lit(0)))
    spread = F.when(F.col("overall") < 50, 0.2).otherwise(0.3)
    return total.withColumns({"least_days": half_up(F.col("total_days") * (1 - spread)), "most_days": half_up(F.col("total_days") * (1 + spread))})


def project_costs(planned: DataFrame, rate: float = 800.0, contingency: float = 20.0, infrastructure: bool = True, licensing: bool = True) -> DataFrame:
    """``planned`` projects with the cost of labour, a tenth for infrastructure, a twentieth for licences, a percentage on top, and the weeks of a team.

    ``team_size`` people share the work with diminishing returns; null means three.
    """
    labor = F.col("total_days") * rate
    infra, licences = labor * (0.1 if infrastructure else 0.0), labor * (0.05 if licensing else 0.0)
    subtotal = labor + infra + licences
    extra = subtotal * (contingency / 100)
    people = F.coalesce(F.col("team_size"), F.lit(3))
    costs = {"labor": labor, "infrastructure": infra, "licensing": licences, "contingency": extra, "total_cost": subtotal + extra}
    weeks = F.ceil(F.col("total_days") / (people * F.least(F.lit(1.0), 0.6 + people * 0.1)) / 5)
    return planned.withColumns({name: half_up(value) for name, value in costs.items()} | {"weeks": weeks})


# D18. Fixed values of the survey: points of a language, multipliers of a complexity level.
LANGUAGE_POINTS = {"cobol": 10, "fortran": 8, "vb6": 6, "vba": 5, "java-legacy": 4}
LEVEL_BOUNDS = ((15, "trivial"), (30, "low"), (50, "medium"), (70, "high"), (85, "very_high"))
#: Defaults of callers' rates: hours a line, multipliers by level, money an hour.
HOURS_A_LINE = {"cobol": 0.05, "fortran": 0.04, "vb6": 0.03}
LEVEL_FACTOR = {"trivial": 0.5, "low": 0.8, "medium": 1.0, "high": 1.5, "very_high": 2.0, "extreme": 3.0}


def code_metrics(sources: DataFrame, key: str, text: str, comment: str, procedure: str, data: str, call: str, branch: str, opens: str, closes: str) -> DataFrame:
    """(key, total_lines, code_lines, comment_lines, blank_lines, procedures, data_structures, external_calls, cyclomatic, nesting) by patterns; at least one procedure."""
    from tessera.operators.mining import text_metrics

    body = F.coalesce(text, F.lit(""))
    lines = F.split(body, "\n")
    counted = lambda p: F.regexp_count(body, F.lit(p)).cast("long")
    of = sources.select(
        key, F.size(lines).cast("long").alias("total_lines"), F.size(F.filter(lines, lambda x: F.trim(x) == "")).cast("long").alias("blank_lines"),
        F.greatest(F.lit(1), counted(procedure)).alias("procedures"), counted(data).alias("data_structures"), counted(call).alias("external_calls"), text,
    )
    metrics = text_metrics(of.withColumn("_rest", F.struct("total_lines", "blank_lines", "procedures", "data_structures", "external_calls")).withColumn("_key", F.struct(key, "_rest")), "_key", text, branch, opens, closes, comment)
    return metrics.select(f"_key.{key}", "_key._rest.total_lines", F.col("loc").alias("code_lines"), F.col("comments").alias("comment_lines"), "_key._rest.blank_lines", "_key._rest.procedures", "_key._rest.data_structures", "_key._rest.external_calls", "cyclomatic", "nesting")


def code_complexity(metrics: DataFrame, language: Column) -> DataFrame:
    """Metrics with ``overall`` (0 to 100: lines on a logarithmic scale, branches, data, calls and the language) and its ``level``."""
    volume = F.least(F.lit(25.0), F.log10(F.col("code_lines") + 1) * 8)
    logic, data, calls = F.least(F.lit(30.0), F.col("cyclomatic") * 0.5), F.least(F.lit(20.0), F.col("data_structures") * 2.0), F.least(F.lit(15.0), F.col("external_calls") * 1.5)
    overall = F.least(F.lit(100), F.floor(F.round(volume + logic + data + calls + _lookup(language, LANGUAGE_POINTS, 5), 9) + 0.5)).cast("int")
    level = F.lit("extreme")
    for bound, name in reversed(LEVEL_BOUNDS):
        level = F.when(F.col("overall") <= bound, name).otherwise(level)
    return metrics.withColumn("overall", overall).withColumn("level", level)


def quick_estimates(rated: DataFrame, language: Column, rate: float = 87.5, contingency: float = 0.2, hours: dict[str, float] = HOURS_A_LINE, otherwise: float = 0.03) -> DataFrame:
    """Least and most days and cost of each source of :func:`code_complexity`: 0.8 and 1.5 of the adjusted hours, the most with contingency."""
    adjusted = F.col("code_lines") * _lookup(language, hours, otherwise) * _lookup(F.col("level"), LEVEL_FACTOR, 1)
    whole = lambda c: F.ceil(F.round(c, 9))
    return rated.withColumn("hours", adjusted).select(
        *[c for c in rated.columns], "hours", whole(F.col("hours") / 8 * 0.8).alias("least_days"), whole(F.col("hours") / 8 * 1.5).alias("most_days"),
        F.floor(F.col("hours") * rate * 0.8 + 0.5).alias("least_cost"), F.floor(F.col("hours") * rate * 1.5 * (1 + contingency) + 0.5).alias("most_cost"),
    )


def batch_metrics(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics of many sources: sums, but the deepest nesting."""
    summed = ("total_lines", "code_lines", "comment_lines", "blank_lines", "procedures", "data_structures", "external_calls", "cyclomatic")
    return metrics.groupBy(*by).agg(F.count("*").alias("files"), *[F.sum(c).alias(c) for c in summed], F.max("nesting").alias("nesting"))


def pipeline_order(levels: DataFrame) -> DataFrame:
    """Levels of :func:`longest_levels`, an error if any node is on or behind a cycle."""
    stuck = levels.where("level IS NULL").orderBy("id").limit(3).collect()
    if stuck:
        raise ValueError("a cycle holds up " + ", ".join(r["id"] for r in stuck))
    return levels
