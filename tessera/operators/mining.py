"""Source-text mining and natural-language questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which lines are candidates of each rule category, by language.
RULE_LINES = {
    "calculation": {"cobol": r"(?i)COMPUTE|ADD|SUBTRACT|MULTIPLY|DIVIDE", "fortran": r"^\s*\w+\s*=\s*[^=]", "vb6": r"^\s*\w+\s*=\s*[^=]", "java": r"^\s*\w+\s*=\s*[^=]"},
    "validation": {"cobol": r"(?i)IF\s+.*\s+(NOT\s+)?(NUMERIC|ALPHABETIC|POSITIVE|NEGATIVE|ZERO)", "fortran": r"(?i)IF\s*\(.*(\.LT\.|\.GT\.|\.EQ\.|\.NE\.|\.LE\.|\.GE\.)", "vb6": r"(?i)If\s+.*\s+(Is|Like|<>|=)", "java": r"if\s*\(.*[<>=!]"},
    "decision": {"cobol": r"(?i)IF\s+|EVALUATE\s+|WHEN\s+", "fortran": r"(?i)IF\s*\(|SELECT\s+CASE", "vb6": r"(?i)If\s+|Select\s+Case", "java": r"if\s*\(|switch\s*\("},
    "transformation": {"cobol": r"(?i)MOVE\s+|STRING\s+|UNSTRING\s+|INSPECT\s+", "fortran": r"(?i)READ\s*\(|WRITE\s*\(", "vb6": r"(?i)CStr|CInt|Format|Mid|Left|Right", "java": r"toString\(|parseInt\(|format\("},
}

# Patterns of entities in questions; the first group is the entity.
ENTITIES = {
    "procedure": (r"(?i)procedure\s+[\"']?(\w+)[\"']?", r"(?i)function\s+[\"']?(\w+)[\"']?", r"(?i)program\s+[\"']?(\w+)[\"']?", r"(?i)subroutine\s+[\"']?(\w+)[\"']?", r"(?i)method\s+[\"']?(\w+)[\"']?", r"(?i)[\"']?([A-Z][A-Z0-9_-]+)[\"']?\s+procedure"),
    "data": (r"(?i)data\s+[\"']?(\w+)[\"']?", r"(?i)field\s+[\"']?(\w+)[\"']?", r"(?i)variable\s+[\"']?(\w+)[\"']?", r"(?i)[\"']?(\w+-?\w*)\s+(field|data|variable)", r"(?i)customer\s+(\w+)", r"(?i)[\"']?([A-Z][A-Z0-9_-]+)[\"']?\s+record"),
    "rule": (r"(?i)rule\s+[\"']?(\w+)[\"']?", r"(?i)business\s+rule\s+[\"']?(\w+)[\"']?", r"(?i)validation\s+[\"']?(\w+)[\"']?", r"(?i)[\"']?(\w+)[\"']?\s+(rule|validation)"),
    "file": (r"(?i)file\s+[\"']?(\w+\.\w+)[\"']?", r"(?i)[\"']?(\w+\.(cbl|cob|f|f90|bas|java))[\"']?", r"(?i)in\s+[\"']?(\w+\.\w+)[\"']?"),
    "system": (r"(?i)system\s+[\"']?(\w+)[\"']?", r"(?i)database\s+[\"']?(\w+)[\"']?", r"(?i)service\s+[\"']?(\w+)[\"']?", r"(?i)api\s+[\"']?(\w+)[\"']?"),
    "concept": (r"(?i)(interest)", r"(?i)(loan)", r"(?i)(payment)", r"(?i)(customer)", r"(?i)(account)", r"(?i)(balance)", r"(?i)(transaction)", r"(?i)(credit)", r"(?i)(eligibility)", r"(?i)(risk)"),
}

# Question intents with their patterns and keywords.
INTENTS = {
    "code-location": ([r"where\s+(is|are|can\s+i\s+find)", r"which\s+file", r"locate\s+", r"find\s+the\s+(code|function|procedure|program)", r"what\s+file\s+(contains|has)"], ["where", "locate", "find", "file", "location", "which file"]),
    "data-flow": ([r"what\s+(uses|reads|writes|modifies|updates|accesses)", r"how\s+is\s+(\w+)\s+(used|modified|processed)", r"where\s+does\s+(\w+)\s+(come\s+from|go)", r"trace\s+(the\s+)?data", r"data\s+flow", r"who\s+(produces|consumes)"], ["uses", "reads", "writes", "modifies", "data flow", "trace", "produces", "consumes"]),
    "business-rule": ([r"what\s+(rule|logic|calculation)\s+(handles|governs|controls)", r"how\s+is\s+(\w+)\s+calculated", r"business\s+rule", r"what\s+are\s+the\s+(rules|validations)", r"how\s+does\s+the\s+system\s+(validate|calculate|determine)"], ["rule", "logic", "calculation", "validate", "business rule", "formula"]),
    "dependency": ([r"what\s+(depends\s+on|relies\s+on)", r"dependencies\s+of", r"what\s+does\s+(\w+)\s+(call|use|depend)", r"show\s+(me\s+)?(the\s+)?dependencies", r"what\s+are\s+the\s+(prerequisites|requirements)"], ["depends", "dependency", "dependencies", "relies", "calls", "uses"]),
    "impact": ([r"what\s+(would|will)\s+(be\s+)?affected", r"impact\s+(of|analysis)", r"if\s+(i|we)\s+(change|modify|update)", r"what\s+breaks\s+if", r"ripple\s+effect", r"downstream\s+(effects|impact)"], ["impact", "affected", "change", "breaks", "downstream", "ripple"]),
    "explanation": ([r"explain\s+(how|what|why)", r"what\s+does\s+(\w+)\s+do", r"how\s+does\s+(\w+)\s+work", r"describe\s+", r"tell\s+me\s+about", r"what\s+is\s+the\s+purpose"], ["explain", "how does", "what does", "describe", "purpose", "work"]),
    "comparison": ([r"compare\s+(\w+)\s+(and|with|to)", r"difference\s+between", r"how\s+(is|are)\s+(\w+)\s+different", r"versus|vs\.?", r"similar\s+to"], ["compare", "difference", "versus", "vs", "similar", "different"]),
    "search": ([r"find\s+all", r"list\s+(all\s+)?(the\s+)?", r"show\s+(me\s+)?(all\s+)?", r"search\s+for", r"get\s+(all|every)", r"what\s+are\s+all\s+the"], ["find all", "list", "show all", "search", "every", "all the"]),
    "summary": ([r"summarize", r"give\s+(me\s+)?(a\s+)?summary", r"overview\s+of", r"brief(ly)?\s+(describe|explain)", r"high[\s-]level", r"in\s+brief"], ["summarize", "summary", "overview", "brief", "high-level"]),
}


def lines(sources: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line number from 1, line) of every source."""
    return sources.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("line_no"), "line")


def rule_lines(numbered: DataFrame, language: str, patterns: dict = RULE_LINES) -> DataFrame:
    """Lines by the category whose pattern they match; a line may have several. Languages without patterns are read as COBOL."""
    found = F.filter(F.array(*[F.when(F.col("line").rlike(p.get(language, p["cobol"])), F.lit(c)) for c, p in patterns.items()]), lambda x: x.isNotNull())
    return numbered.withColumn("category", F.explode(found))


def captured(numbered: DataFrame, key: str, pattern: str) -> DataFrame:
    """Distinct first groups of a pattern."""
    return numbered.select(key, F.explode(F.regexp_extract_all("line", F.lit(pattern), 1)).alias("name")).distinct()


def inputs_outputs(numbered: DataFrame, key: str) -> DataFrame:
    """(key, direction, name), each once: what a program accepts and reads, displays and writes."""
    rows = []
    for direction, verb in (("input", "ACCEPT"), ("input", "READ"), ("output", "DISPLAY"), ("output", "WRITE")):
        rows.append(F.transform(F.regexp_extract_all("line", F.lit(rf"(?i)\b{verb}\s+([\w-]+)"), 1), _directed(direction)))
    return numbered.select(key, F.explode(F.flatten(F.array(*rows))).alias("x")).select(key, "x.*").distinct()


def _directed(direction: str):
    return lambda name: F.struct(F.lit(direction).alias("direction"), name.alias("name"))


def file_operations(numbered: DataFrame, key: str) -> DataFrame:
    """(key, line_no, operation, file): the first OPEN with its mode, READ and WRITE of each line."""
    mode, opened = F.regexp_extract("line", r"(?i)OPEN\s+(INPUT|OUTPUT|I-O|EXTEND)\s+(\w+)", 1), F.regexp_extract("line", r"(?i)OPEN\s+(INPUT|OUTPUT|I-O|EXTEND)\s+(\w+)", 2)
    rows = [F.struct(mode.alias("operation"), opened.alias("file"))] + [F.struct(F.lit(v).alias("operation"), F.regexp_extract("line", rf"(?i){v}\s+(\w+)", 1).alias("file")) for v in ("READ", "WRITE")]
    return numbered.select(key, "line_no", F.explode(F.filter(F.array(*rows), lambda x: x["file"] != "")).alias("x")).select(key, "line_no", "x.*")


def database_calls(numbered: DataFrame, key: str) -> DataFrame:
    """(key, line_no, kind) of lines with EXEC SQL: the first verb in the line, else SQL."""
    verb = F.upper(F.regexp_extract("line", r"(?i)(SELECT|INSERT|UPDATE|DELETE|CALL)", 1))
    return numbered.where(F.col("line").rlike(r"(?i)EXEC\s+SQL")).select(key, "line_no", F.when(verb == "", "SQL").otherwise(verb).alias("kind"))


def external_calls(numbered: DataFrame, key: str) -> DataFrame:
    """(key, line_no, name) of the first CALL of each line."""
    name = F.regexp_extract("line", r"(?i)CALL\s+['\"]?(\w+)['\"]?", 1)
    return numbered.select(key, "line_no", name.alias("name")).where("name <> ''")


def compare_outputs(legacy: DataFrame, modern: DataFrame, keys: Sequence[str], value: str, tolerance: float = 0.01) -> DataFrame:
    """Keys of the legacy side whose value is missing or differs by more than the tolerance; significant over ten times that."""
    joined = legacy.select(*keys, F.col(value).alias("legacy")).join(modern.select(*keys, F.col(value).alias("modern")), list(keys), "left")
    delta = F.abs(F.col("legacy") - F.col("modern"))
    return joined.withColumn("significant", F.col("modern").isNull() | (delta > 10 * tolerance)).where(F.col("modern").isNull() | (delta > tolerance))


def covered(rules: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """One row: rules, covered ones, their percentage, and the first ten that nothing covers."""
    marked = rules.select(key).join(used.select(key).distinct().withColumn("hit", F.lit(1)), key, "left")
    first = marked.where("hit IS NULL").orderBy(key).limit(10).agg(F.array_sort(F.collect_list(key)).alias("uncovered"))
    of = marked.agg(F.count("*").alias("rules"), F.count("hit").alias("covered"), F.coalesce(F.try_divide(F.count("hit") * 100.0, F.count("*")), F.lit(100.0)).alias("percent"))
    return of.join(first)


def document_aggregates(rules: DataFrame, procedures: DataFrame) -> dict[str, DataFrame]:
    """Rules by category, critical calculations, complex procedures with their risk tier, and review statuses.

    ``rules``: id, category, criticality, review_status, confidence; ``procedures``: id, complexity.
    """
    tier = F.when(F.col("complexity") > 50, "high").when(F.col("complexity") > 30, "medium").otherwise("low")
    return {
        "categories": rules.groupBy("category").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence")),
        "critical": rules.where("criticality = 'critical'").orderBy(F.desc("confidence"), "id").limit(10),
        "complex": procedures.where("complexity > 20").orderBy(F.desc("complexity"), "id").limit(10).withColumn("risk", tier),
        "reviews": rules.groupBy("review_status").agg(F.count("*").alias("n")),
    }


def moves(numbered: DataFrame, key: str) -> DataFrame:
    """Edges of ``MOVE a TO b``, the first of each line."""
    pattern = r"(?i)MOVE\s+([\w-]+)\s+TO\s+([\w-]+)"
    a, b = F.regexp_extract("line", pattern, 1), F.regexp_extract("line", pattern, 2)
    return numbered.select(key, "line_no", a.alias("source"), b.alias("target")).where("source <> ''")


def variable_uses(numbered: DataFrame, name: str) -> DataFrame:
    """P5: lines that name a variable, as definition, modification or use."""
    kind = F.when(F.col("line").rlike(rf"(?i)\b\d\d\s+{name}\b"), "definition").when(F.col("line").rlike(rf"(?i)\bTO\s+{name}\b|\b{name}\s*="), "modification").otherwise("use")
    return numbered.where(F.col("line").rlike(rf"(?i)\b{name}\b")).withColumn("kind", kind)


def text_metrics(sources: DataFrame, key: str, text: str, branch: str, opens: str, closes: str, comment: str) -> DataFrame:
    """Lines of code, comments, cyclomatic number and deepest nesting (never below 0) in one projection."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n")
    blank, note = lambda x: F.trim(x) == "", lambda x: x.rlike(comment)

    def step(state: Column, line: Column) -> Column:
        depth = F.greatest(F.lit(0), state["depth"] + F.regexp_count(line, F.lit(opens)) - F.regexp_count(line, F.lit(closes)))
        return F.struct(depth.alias("depth"), F.greatest(state["deepest"], depth).alias("deepest"))

    nesting = F.aggregate(parts, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("deepest")), step)["deepest"]
    code = F.size(F.filter(parts, lambda x: ~blank(x) & ~note(x)))
    return sources.select(
        key, code.cast("long").alias("loc"), F.size(F.filter(parts, note)).cast("long").alias("comments"), (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(branch)) + 1).cast("long").alias("cyclomatic"), nesting.cast("long").alias("nesting")
    )


def detect_source_language(sources: DataFrame, key: str, text: str, patterns: Sequence[tuple[str, str, int]]) -> DataFrame:
    """10 x weight for each matching (language, pattern, weight); the highest wins, ties by name; none is cobol."""
    scores = F.array(*[F.struct((F.lit(10 * w) * F.col(text).rlike(p).cast("int")).alias("score"), F.lit(name).alias("language")) for name, p, w in patterns])
    long = sources.select(key, F.explode(scores).alias("x")).groupBy(key, "x.language").agg(F.sum("x.score").alias("score"))
    best = long.groupBy(key).agg(F.min_by(F.struct("language", "score"), F.struct(-F.col("score"), "language")).alias("b"), F.sum("score").alias("total"))
    confidence = F.least(F.lit(0.99), F.col("b.score") / F.greatest(F.col("total"), F.lit(50)))
    return best.select(key, F.when(F.col("b.score") > 0, F.col("b.language")).otherwise("cobol").alias("language"), confidence.alias("confidence"))


def readiness(equivalence: Column, coverage: Column, critical: Column) -> Column:
    """P10: 0.6 equivalence + 0.4 coverage - 10 for each critical finding, within 0 to 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 0.6 * equivalence + 0.4 * coverage - 10 * critical))


def classify(questions: DataFrame, key: str, text: str, intents: dict = INTENTS) -> DataFrame:
    """10 for each pattern, 5 for each keyword; the highest intent (ties to the first listed), or unknown."""
    low = F.lower(text)

    def score(patterns, keywords) -> Column:
        total = F.lit(0)
        for p in patterns:
            total = total + 10 * low.rlike(p).cast("int")
        for k in keywords:
            total = total + 5 * low.contains(k).cast("int")
        return total

    rows = F.array(*[F.struct((-score(*v)).alias("neg"), F.lit(k).alias("place"), F.lit(name).alias("intent")) for k, (name, v) in enumerate(intents.items())])
    scored = questions.select(key, F.array_sort(rows).alias("r"), F.aggregate(rows, F.lit(0), lambda a, x: a - x["neg"]).alias("total"))
    top = -F.col("r")[0]["neg"]
    bonus = F.when(top > 15, 0.2).otherwise(0.0)
    confidence = F.when(top > 0, F.least(F.lit(0.95), F.try_divide(top, F.col("total")) + bonus)).otherwise(0.0)
    return scored.select(key, F.when(top > 0, F.col("r")[0]["intent"]).otherwise("unknown").alias("intent"), F.round(confidence, 6).alias("confidence"))


def entities(questions: DataFrame, key: str, text: str, patterns: dict[str, Sequence[str]] = ENTITIES) -> DataFrame:
    """(key, type, entity): the first capture of each pattern, case-insensitively distinct, the first spelling and type kept."""
    found, place = [], 0
    for kind, some in patterns.items():
        for p in some:
            found.append(F.struct(F.lit(place).alias("place"), F.lit(kind).alias("type"), F.regexp_extract(text, p, 1).alias("entity")))
            place += 1
    long = questions.select(key, F.explode(F.filter(F.array(*found), lambda x: x["entity"] != "")).alias("x")).select(key, "x.*")
    best = long.groupBy(key, F.lower("entity").alias("_e")).agg(F.min_by(F.struct("type", "entity"), "place").alias("b"))
    return best.select(key, "b.type", "b.entity")


def ranked_nodes(nodes: DataFrame, entities_: Sequence[str], keywords: Sequence[str], limit: int = 20) -> DataFrame:
    """An entity in the name counts 20, in the description 10; a keyword 5, 3 and 2 for a tag. ``description`` and ``tags`` may be missing."""
    has = lambda c, w: F.coalesce(F.lower(c).contains(w.lower()), F.lit(False)).cast("int")
    score = F.lit(0)
    for words, in_name, in_text, in_tag in ((entities_, 20, 10, 0), (keywords, 5, 3, 2)):
        for w in words:
            score = score + in_name * has("name", w)
            if "description" in nodes.columns:
                score = score + in_text * has("description", w)
            if "tags" in nodes.columns and in_tag:
                score = score + in_tag * F.exists("tags", _holds(w)).cast("int")
    return nodes.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def _holds(word: str):
    return lambda t: F.lower(t).contains(word.lower())


def by_keywords(rows: DataFrame, columns: Sequence[str], keywords: Sequence[str], types: Sequence[str] = ()) -> DataFrame:
    """Rows of the types with any keyword in any of the columns."""
    any_ = F.lit(False)
    for k in keywords:
        for c in columns:
            any_ = any_ | F.coalesce(F.lower(c).contains(k.lower()), F.lit(False))
    return (rows.where(F.col("type").isin(*types)) if types else rows).where(any_)


# Fixed values of the survey: what answers say.
NOTHING = "I couldn't find specific information matching your question. Try rephrasing or being more specific about what you're looking for."
NO_LOCATION, NO_FLOW, NO_RULE, NO_DEPENDENCY = "No matching code locations found.", "No data flows found for the specified data.", "No matching business rules found.", "No dependencies found."
NO_IMPACT, NO_EXPLANATION, NO_RESULT, NO_INFORMATION = "No downstream impact detected.", "No information found to explain.", "No results found.", "No relevant information found."


def _first(rows: DataFrame | None, questions: DataFrame, key: str, order: Sequence[Column], fields: Sequence[str], most: int, name: str) -> DataFrame:
    """(key, name, n_name) of every question: its first ``most`` rows in order, and how many it has; fields that rows lack are null."""
    if rows is None:
        fields_ = ", ".join(f"{f}: string" for f in fields)
        return questions.select(key, F.array().cast(f"array<struct<{fields_}>>").alias(name), F.lit(0).cast("long").alias(f"n_{name}"))
    from pyspark.sql import Window

    own = rows.select(key, *[F.col(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in fields], F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("_k"))
    top = own.where(F.col("_k") <= most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_k", F.struct(*fields).alias("x")))).alias("_r"))
    counts = rows.groupBy(key).agg(F.count("*").alias(f"n_{name}"))
    return counts.join(top, key).select(key, F.transform("_r", lambda r: r["x"]).alias(name), f"n_{name}")


def answers(questions: DataFrame, nodes: DataFrame, rules: DataFrame | None = None, flows: DataFrame | None = None, paths: DataFrame | None = None, key: str = "question_id", level: str = "normal", most: int = 20) -> DataFrame:
    """(key, answer, sources, follow_ups) of ``questions(key, intent)`` from what was found.

    ``nodes(key, id, name, type, score)`` may have ``description`` and
    ``location``; ``rules(key, name, category, description, confidence)`` may
    have ``formula``; ``flows(key, item, producers, consumers)`` names them in
    one text each; ``paths(key, steps)`` too, in arrows. Rows are told best
    first: nodes by score and id, others by name. The answer's form follows the
    intent, its length ``level`` (brief, normal or detailed); the follow-ups
    ask on about the first node and rule found, not again by the same intent.
    Each question keeps ``most`` nodes at most, picked before they are shuffled
    together.
    """
    if level not in ("brief", "normal", "detailed"):
        raise ValueError(f"no level {level}")
    found = questions.select(key, "intent")
    by_name = lambda c: [F.col(c)]
    for rows, order, fields, name in (
        (nodes, [F.desc("score"), F.col("id")], ("id", "name", "type", "description", "location"), "nodes"), (nodes.where("type = 'business-rule'"), [F.desc("score"), F.col("id")], ("name", "description"), "rule_nodes"),
        (rules, by_name("name"), ("name", "category", "description", "formula", "confidence"), "rules"), (flows, by_name("item"), ("item", "producers", "consumers"), "flows"), (paths, by_name("steps"), ("steps",), "paths"),
    ):
        found = found.join(_first(rows, questions, key, order, fields, most, name), key, "left").fillna(0, [f"n_{name}"])
    kinds = nodes.groupBy(key, "type").agg(F.count("*").alias("n"), F.min(F.struct(-F.col("score"), "id")).alias("_first"))
    kinds = kinds.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "type", "n"))), lambda x: F.concat(F.lit("\u2022 "), x["n"].cast("string"), F.lit(" "), x["type"], F.lit("(s)"))).alias("kinds"))
    found = found.join(kinds, key, "left")

    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    nodes_, rules_, flows_ = F.col("nodes"), F.col("rules"), F.col("flows")
    listed = lambda rows, count, line: F.array_join(F.transform(F.slice(rows, 1, count), line), "\n")
    described = lambda n, other: F.coalesce(F.nullif(n["description"], F.lit("")), F.lit(other))
    bullet = lambda n: text("\u2022 **", n["name"], "** (", n["type"], ")")
    n_nodes = F.col("n_nodes").cast("string")
    nothing = lambda n, message, answer: F.when(F.col(n) == 0, message).otherwise(answer)

    where = F.array_join(F.transform(nodes_, lambda n: n["name"]), ", ")
    location = text("Found in: ", where) if level == "brief" else text("I found ", n_nodes, " relevant location(s):\n\n", listed(nodes_, 5, lambda n: text(bullet(n), F.coalesce(text(" (", n["location"], ")"), F.lit("")), ": ", described(n, "No description"))))
    side = lambda label, names: F.when(F.coalesce(names, F.lit("")) != "", text("\n  \u2022 ", label, " by: ", names)).otherwise("")
    flow = text("Data flow analysis:\n\n", listed(flows_, 3, lambda f: text("**", f["item"], "**:", side("Produced", f["producers"]), side("Consumed", f["consumers"]))))
    formula = lambda r: F.when((F.coalesce(r["formula"], F.lit("")) != "") & F.lit(level != "brief"), text("\n  Formula: `", r["formula"], "`")).otherwise("")
    percent = lambda r: F.floor(r["confidence"].cast("double") * 100 + 0.5).cast("string")
    rule_lines = F.transform(F.slice(rules_, 1, 5), lambda r: text("**", r["name"], "** (", r["category"], "):\n  ", r["description"], formula(r), "\n  Confidence: ", percent(r), "%"))
    rest = F.slice(F.transform("rule_nodes", lambda n: text("**", n["name"], "**: ", described(n, "Business rule"))), F.lit(1), F.greatest(F.lit(0), 5 - F.coalesce(F.col("n_rules"), F.lit(0))).cast("int"))
    n_rules = F.col("n_rules") + F.col("n_rule_nodes")
    empty = F.array().cast("array<string>")
    rule = text("Found ", n_rules.cast("string"), " business rule(s):\n\n", F.array_join(F.concat(F.coalesce(rule_lines, empty), F.coalesce(rest, empty)), "\n"))
    ways = text("\n\n**Impact paths:**\n", listed(F.col("paths"), 3, lambda p: text("  ", p["steps"])))
    impact = text("**", F.least(F.lit(10), F.col("n_nodes")).cast("string"), " components would be affected:**\n\n", listed(nodes_, 10, lambda n: text("\u2022 ", n["name"], " (", n["type"], ")")), F.when((F.col("n_paths") > 0) & F.lit(level == "detailed"), ways).otherwise(""))
    first = nodes_[0]
    on = F.regexp_extract(F.col("paths")[0]["steps"], "(?s)^.*? \u2192 (.*)$", 1)
    leads = F.when((F.col("n_paths") > 0) & (on != "") & F.lit(level != "brief"), text("\n\nIt connects to: ", F.replace(on, F.lit(" \u2192 "), F.lit(", ")))).otherwise("")
    explanation = text("**", first["name"], "** is a ", first["type"], ".", F.when(F.coalesce(first["description"], F.lit("")) != "", text("\n", first["description"])).otherwise(""), leads)
    cut = lambda c, n: F.substring(c, 1, n)
    results = text("Found ", n_nodes, " result(s):\n\n", listed(nodes_, 15, lambda n: text(bullet(n), F.when(F.coalesce(n["description"], F.lit("")) != "", text(": ", cut(n["description"], 60))).otherwise(""))))
    key_rules = text("\n\n**Key Business Rules:**\n", listed(rules_, 3, lambda r: text("\u2022 ", r["name"], ": ", cut(r["description"], 80))))
    summary = text("**System Overview:**\n", F.when(F.col("n_nodes") > 0, text("\n", F.array_join("kinds", "\n"))).otherwise(""), F.when(F.col("n_rules") > 0, key_rules).otherwise(""))
    generic = text("Here's what I found:\n\n", listed(nodes_, 10, lambda n: text(bullet(n), ": ", described(n, "No description"))))
    forms = {
        "code-location": nothing("n_nodes", NO_LOCATION, location), "data-flow": nothing("n_flows", NO_FLOW, flow), "business-rule": F.when(n_rules == 0, NO_RULE).otherwise(rule),
        "dependency": nothing("n_nodes", NO_DEPENDENCY, text("Found ", n_nodes, " dependencies:\n\n", listed(nodes_, 10, bullet))), "impact": nothing("n_nodes", NO_IMPACT, impact),
        "explanation": nothing("n_nodes", NO_EXPLANATION, explanation), "search": nothing("n_nodes", NO_RESULT, results), "summary": summary,
    }
    answer = nothing("n_nodes", NO_INFORMATION, generic)
    for intent, form in forms.items():
        answer = F.when(F.col("intent") == intent, form).otherwise(answer)
    answer = F.when((F.col("n_nodes") == 0) & (F.col("n_rules") == 0), NOTHING).otherwise(answer)

    asks, name, rule_name = F.col("intent"), first["name"], rules_[0]["name"]
    some, rule_found = F.col("n_nodes") > 0, F.col("n_rules") > 0
    follow = F.array(
        F.when(some & (asks != "impact"), text("What would be affected if ", name, " changes?")), F.when(some & (asks != "dependency"), text("What does ", name, " depend on?")),
        F.when(some & (asks != "data-flow") & (first["type"] == "data-structure"), text("Show me the data flow for ", name)), F.when(some & (asks != "explanation"), text("Explain how ", name, " works")),
        F.when(rule_found, text("What data does ", rule_name, " use?")), F.when(rule_found, text("Where is ", rule_name, " implemented?")),
    )
    sources = F.coalesce(F.slice(F.transform("nodes", lambda n: n["id"]), 1, 10), empty)
    return found.select(key, answer.alias("answer"), sources.alias("sources"), F.slice(F.array_compact(follow), 1, 4).alias("follow_ups"))


def answer_confidence(base: Column, found: Column) -> Column:
    """0.3 of the intent's confidence if nothing was found, 1.1 of it over five nodes, within 0.1 to 0.95."""
    return F.greatest(F.lit(0.1), F.least(F.lit(0.95), base * F.when(found == 0, 0.3).when(found > 5, 1.1).otherwise(1.0)))


def last_turns(turns: DataFrame, by: str, order: str, keep: int = 20) -> DataFrame:
    """The last turns of every conversation."""
    return turns.withColumn("_r", F.expr(f"row_number() OVER (PARTITION BY {by} ORDER BY {order} DESC)")).where(F.col("_r") <= keep).drop("_r")


# Operators of rule conditions.
CONDITIONS = {
    "equals": lambda c, v: c == v, "not_equals": lambda c, v: c != v, "greater_than": lambda c, v: c > v, "less_than": lambda c, v: c < v, "greater_or_equal": lambda c, v: c >= v, "less_or_equal": lambda c, v: c <= v,
    "contains": lambda c, v: c.contains(v), "starts_with": lambda c, v: c.startswith(v), "ends_with": lambda c, v: c.endswith(v), "in": lambda c, v: c.isin(*v), "is_null": lambda c, v: c.isNull(), "matches": lambda c, v: c.rlike(v),
}


def compile_condition(rule: dict) -> Column:
    """a nested rule (all, any, not, or field-operator-value) as a Column; unknown operators raise."""
    if "all" in rule or "any" in rule:
        parts = [compile_condition(r) for r in rule.get("all", rule.get("any"))]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if "all" in rule else out | p
        return out
    if "not" in rule:
        return ~compile_condition(rule["not"])
    return CONDITIONS[rule["operator"]](F.col(rule["field"]), rule.get("value"))


def rule_domains(rules: DataFrame, name: str) -> DataFrame:
    """Rules by the first word of their name, in lower case."""
    return rules.groupBy(F.lower(F.split(name, " ")[0]).alias("domain")).agg(F.count("*").alias("n"))


def lineage(flows: DataFrame, sources: DataFrame, targets: DataFrame, source_key: str, target_key: str, source: str, target: str) -> DataFrame:
    """(source, target, flows): how often each named source flows into each named target; ends without a name are left out."""
    named = flows.join(sources.select(source_key, F.col(source).alias("source")), source_key).join(targets.select(target_key, F.col(target).alias("target")), target_key)
    return named.groupBy("source", "target").agg(F.count("*").alias("flows"))
