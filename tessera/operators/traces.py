"""Execution traces: metrics, stacks, paths, coverage, mined rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.quality import hash_unit

#: A trace event: session_id, seq (from 1, unique in its session), type, value.
BY_SEQ = "PARTITION BY session_id ORDER BY seq"


def sampled(events: DataFrame, key: str, rate: float) -> DataFrame:
    """A deterministic share of keys by hash; a key is kept whole."""
    return events.where(hash_unit(key) < rate)


# What a tracer of each language calls an event, as one of the common types.
EVENT_TYPES = {
    "cobol": {"PROGRAM": "procedure_entry", "GOBACK": "procedure_exit", "PERFORM": "procedure_entry", "EXIT": "procedure_exit", "CALL": "external_call", "RETURN": "external_return", "IF": "branch_taken", "EVALUATE": "branch_taken", "MOVE": "variable_write", "COMPUTE": "variable_write", "PERFORM-UNTIL": "loop_iteration", "OPEN": "file_open", "READ": "file_read", "WRITE": "file_write", "CLOSE": "file_close", "EXEC-SQL": "db_query", "SQLCODE": "db_result", "ABEND": "error"},
    "fortran": {"PROGRAM": "procedure_entry", "END": "procedure_exit", "SUBROUTINE": "procedure_entry", "FUNCTION": "procedure_entry", "RETURN": "procedure_exit", "CALL": "external_call", "CALL-RETURN": "external_return", "IF": "branch_taken", "ASSIGN": "variable_write", "DO": "loop_iteration", "OPEN": "file_open", "READ": "file_read", "WRITE": "file_write", "CLOSE": "file_close", "STOP": "error"},
    "java": {"enter": "procedure_entry", "exit": "procedure_exit", "invoke": "external_call", "return": "external_return", "branch": "branch_taken", "assign": "variable_write", "loop": "loop_iteration", "query": "db_query", "result": "db_result", "throw": "error"},
}


def normalized(events: DataFrame, language: str, kind: str = "kind") -> DataFrame:
    """T5: raw events of a language's tracer with ``type``, one of the common event types; kinds that the language does not know are left out."""
    out = F.lit(None).cast("string")
    for name, common in EVENT_TYPES[language].items():
        out = F.when(F.upper(kind) == name.upper(), common).otherwise(out)
    return events.withColumn("type", out).where("type IS NOT NULL")


def first_of_session(events: DataFrame, most: int = 100_000) -> DataFrame:
    """At most so many events of each session."""
    return events.where(F.col("seq") <= most)


def masked(c: Column, keep: int = 2) -> Column:
    """The first and last characters, stars between."""
    inner = F.greatest(F.length(c) - 2 * keep, F.lit(0))
    return F.when(F.length(c) <= 2 * keep, F.repeat(F.lit("*"), F.length(c))).otherwise(F.concat(F.left(c, F.lit(keep)), F.repeat(F.lit("*"), inner), F.right(c, F.lit(keep))))


def type_metrics(events: DataFrame, types: Sequence[str]) -> DataFrame:
    """Counts of each event type by session, one pass."""
    return events.groupBy("session_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in types])


def call_depth(events: DataFrame, enter: Sequence[str], leave: Sequence[str]) -> DataFrame:
    """T4: depth after each event, never below 0 (unmatched exits are ignored)."""
    step = F.when(F.col("type").isin(*enter), 1).when(F.col("type").isin(*leave), -1).otherwise(0)
    running = events.withColumn("_sum", F.sum(step).over(_window()))
    lowest = F.least(F.lit(0), F.min("_sum").over(_window()))
    return running.withColumn("depth", (F.col("_sum") - lowest).cast("long")).drop("_sum")


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)


def islands(events: DataFrame, by: str = "type") -> DataFrame:
    """Runs of equal consecutive values: session, first seq, value, length (gaps and islands)."""
    change = F.expr(f"CASE WHEN {by} <=> lag({by}) OVER ({BY_SEQ}) AND seq > 1 THEN 0 ELSE 1 END")
    marked = events.withColumn("_new", change).withColumn("island", F.expr(f"sum(_new) OVER ({BY_SEQ} ROWS UNBOUNDED PRECEDING)"))
    return marked.groupBy("session_id", "island").agg(F.min("seq").alias("first_seq"), F.first(by).alias("value"), F.count("*").alias("length"))


def procedure_stats(depths: DataFrame, enter: Sequence[str], leave: Sequence[str], ts: str = "ts") -> DataFrame:
    """Calls and mean milliseconds: the k-th entry at a depth meets the k-th exit from it; unmatched entries count without time."""
    begin = depths.where(F.col("type").isin(*enter)).withColumn("k", F.expr("row_number() OVER (PARTITION BY session_id, depth ORDER BY seq)"))
    end = depths.where(F.col("type").isin(*leave)).select("session_id", (F.col("depth") + 1).alias("depth"), F.col(ts).alias("end_ts"), F.expr("row_number() OVER (PARTITION BY session_id, depth ORDER BY seq)").alias("k"))
    millis = (F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1000
    paired = begin.join(end, ["session_id", "depth", "k"], "left")
    return paired.groupBy("type", "depth").agg(F.count("*").alias("calls"), F.count("end_ts").alias("closed"), F.avg(F.when(millis >= 0, millis)).alias("mean_ms"))


def callers(depths: DataFrame, enter: Sequence[str], name: str = "type") -> DataFrame:
    """(caller, callee, calls): each entry with the last one before it that is one level up in its session; entries at depth 1 have no caller."""
    entries = depths.where(F.col("type").isin(*enter)).select("session_id", "seq", "depth", F.col(name).alias("callee"))
    # An entry's caller is the last entry of the depth above that came before it, so levels meet by (session, level) in order.
    marks = entries.select("session_id", F.col("depth").alias("level"), "seq", F.col("callee").alias("opened"), F.lit(None).cast("string").alias("callee"))
    asks = entries.where("depth > 1").select("session_id", (F.col("depth") - 1).alias("level"), "seq", F.lit(None).cast("string").alias("opened"), "callee")
    found = marks.unionByName(asks).withColumn("caller", F.expr("last(opened, true) OVER (PARTITION BY session_id, level ORDER BY seq ROWS UNBOUNDED PRECEDING)"))
    return found.where("callee IS NOT NULL AND caller IS NOT NULL").groupBy("caller", "callee").agg(F.count("*").alias("calls"))


def snapshots(events: DataFrame, name: str, value: str, ts: str, millis: int = 100) -> DataFrame:
    """The last value of each variable in every tumbling window of ``millis``."""
    slot = F.floor(F.unix_millis(F.col(ts).cast("timestamp")) / millis)
    return events.groupBy("session_id", F.col(name).alias("name"), slot.alias("slot")).agg(F.max_by(value, "seq").alias("value"))


def reads_before(events: DataFrame, write: str, read: str, back: int = 10) -> DataFrame:
    """Writes with the values read in the ``back`` events before them."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(-back, -1)
    return events.withColumn("reads", F.collect_list(F.when(F.col("type") == read, F.col("value"))).over(w)).where(F.col("type") == write).select("session_id", "seq", "value", "reads")


def frequent(events: DataFrame, by: Sequence[str], least: int = 2) -> DataFrame:
    """Groups that occur often enough."""
    return events.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def learned_calculations(observations: DataFrame, place: str, result: str, least: int = 5) -> DataFrame:
    """Places seen ``least`` times or more whose result never changes: (place, n, constant)."""
    grouped = observations.groupBy(place).agg(F.count("*").alias("n"), F.min(result).alias("constant"), F.max(result).alias("_high"))
    return grouped.where((F.col("n") >= least) & F.col("constant").eqNullSafe(F.col("_high"))).drop("_high")


def learned_validations(observations: DataFrame, condition: str, holds: str, least: int = 5) -> DataFrame:
    """(condition, n, frequency): how often each condition held, seen ``least`` times or more."""
    return observations.groupBy(condition).agg(F.count("*").alias("n"), F.avg(F.col(holds).cast("double")).alias("frequency")).where(F.col("n") >= least)


def learned_decisions(events: DataFrame, outcome: str = "type", path_types: Sequence[str] = (), least: int = 5) -> DataFrame:
    """(path, outcome, n): all branches of each session, in order, with the session's last event."""
    branches = events.where(F.col("type").isin(*path_types))
    paths = branches.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "type"))), lambda x: x["type"]), ">").alias("path"))
    last = events.groupBy("session_id").agg(F.max_by(outcome, "seq").alias("outcome"))
    return paths.join(last, "session_id").groupBy("path", "outcome").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def learned_transforms(observations: DataFrame, place: str, given: str, result: str, least: int = 5) -> DataFrame:
    """(place, transform, n): which of upper, lower, trim and identity explains all of a place's pairs; the first of these that does."""
    a, b = F.col(given), F.col(result)
    kinds = {"identity": b == a, "upper": b == F.upper(a), "lower": b == F.lower(a), "trim": b == F.trim(a)}
    grouped = observations.groupBy(place).agg(F.count("*").alias("n"), *[F.bool_and(v).alias(k) for k, v in kinds.items()]).where(F.col("n") >= least)
    first = F.coalesce(*[F.when(F.col(k), k) for k in kinds])
    return grouped.select(place, first.alias("transform"), "n").where("transform IS NOT NULL")


def field_signature(events: DataFrame, field: str, by: Sequence[str] = (), most: int = 10) -> DataFrame:
    """Count, nulls, distinct values, range; the ``most`` least values as examples."""
    value = F.col(field)
    base = events.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(value.isNull()).alias("nulls"), F.count_distinct(field).alias("cardinality"), F.min(field).alias("low"), F.max(field).alias("high"))
    values = events.where(value.isNotNull()).select(*by, field).distinct()
    ranked = values.withColumn("_r", F.expr(f"row_number() OVER (PARTITION BY {', '.join(by)} ORDER BY {field})")).where(F.col("_r") <= most) if by else values.orderBy(field).limit(most)
    examples = ranked.groupBy(*by).agg(F.array_sort(F.collect_list(field)).alias("examples"))
    return base.join(examples, list(by), "left") if by else base.join(examples)


def rule_hits(events: DataFrame, ranges: DataFrame, width: int = 64) -> DataFrame:
    """Events ``e`` whose line is inside a rule's range ``r``; an equi-join on file and bin of lines, then the bounds."""
    e = events.withColumn("bin", F.floor(F.col("line") / width)).alias("e")
    touched = F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))
    r = ranges.where("first <= last").withColumn("bin", F.explode(touched)).alias("r")
    return e.join(r, (F.col("e.file") == F.col("r.file")) & (F.col("e.bin") == F.col("r.bin")) & F.col("e.line").between(F.col("r.first"), F.col("r.last")))


def range_counts(events: DataFrame, ranges: DataFrame) -> DataFrame:
    """Those of ``ranges`` that hold an event, with their number of events as ``hits``.

    Events are counted by line and equal ranges meet them once, so the join grows with
    the lines that different ranges span, not with events times rules.
    """
    keys = ["file", "first", "last"]
    found = rule_hits(events.groupBy("file", "line").agg(F.count("*").alias("n")), ranges.select(*keys).distinct())
    return ranges.join(found.groupBy(*[F.col(f"r.{k}").alias(k) for k in keys]).agg(F.sum("e.n").alias("hits")), keys)


def validated_rules(events: DataFrame, rules: DataFrame, share: float = 0.3, accepted: float = 0.7, examples: int = 5) -> DataFrame:
    """(rule, events, matched, match_rate, valid, first_words) of rules(file, first, last, rule, terms) on events(file, line, text).

    An event in a rule's lines matches if it has ``share`` of the rule's terms
    or more; the rule is valid from a rate of ``accepted``. ``first_words`` are
    the most frequent first words of its events. Of an event's words those count
    that some rule of its file names: events of one line that agree in them and in
    the first word meet equal ranges once, with their number.
    """
    kinds = rules.select("file", "first", "last", "terms").distinct()
    named = kinds.select("file", F.explode("terms").alias("term")).distinct().withColumn("named", F.col("term"))
    texts = events.groupBy("file", "line", "text").agg(F.count("*").alias("n"))
    worded = texts.withColumn("term", F.explode_outer(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+")))).join(named, ["file", "term"], "left")
    told = worded.groupBy("file", "line", "text", "n").agg(F.array_sort(F.collect_set("named")).alias("words"))
    words = F.when(F.col("text").isNotNull(), F.col("words"))
    alike = told.groupBy("file", "line", words.alias("words"), F.split(F.lower(F.trim("text")), r"\s+")[0].alias("word")).agg(F.sum("n").alias("n"))
    overlap = F.size(F.array_intersect("r.terms", "e.words")) >= share * F.size("r.terms")
    met = rule_hits(alike, kinds).groupBy("r.file", "r.first", "r.last", "r.terms", "e.word").agg(F.sum("e.n").alias("n"), F.sum(F.when(overlap, F.col("e.n")).otherwise(0)).alias("ok")).alias("m")
    same = (F.col("u.file") == F.col("m.file")) & (F.col("u.first") == F.col("m.first")) & (F.col("u.last") == F.col("m.last")) & F.col("u.terms").eqNullSafe(F.col("m.terms"))
    hits = rules.alias("u").join(met, same).groupBy("u.rule", "m.word").agg(F.sum("m.n").alias("n"), F.sum("m.ok").alias("ok"))
    ranked = hits.withColumn("_k", F.expr("row_number() OVER (PARTITION BY rule ORDER BY n DESC, word)"))
    first = F.array_sort(F.collect_list(F.when(F.col("_k") <= examples, F.struct("_k", "word"))))
    rates = ranked.groupBy("rule").agg(F.sum("n").alias("events"), F.sum("ok").alias("matched"), F.array_join(F.transform(first, lambda x: x["word"]), " ").alias("first_words"))
    rate = F.col("matched") / F.col("events")
    return rates.select("rule", "events", "matched", rate.alias("match_rate"), (rate >= accepted).alias("valid"), "first_words")


def branch_coverage(events: DataFrame, place: Sequence[str], taken: str) -> tuple[DataFrame, DataFrame]:
    """One row (locations, observed, coverage in percent, 100 without locations), and the places with the side that was never taken."""
    sides = events.groupBy(*place).agg(F.bool_or(taken).alias("taken"), F.bool_or(~F.col(taken)).alias("not_taken"))
    seen = F.sum(F.col("taken").cast("int") + F.col("not_taken").cast("int"))
    total = sides.agg(F.count("*").alias("locations"), F.coalesce(seen, F.lit(0)).alias("observed"), F.coalesce(F.try_divide(seen * 100.0, F.count("*") * 2), F.lit(100.0)).alias("coverage"))
    return total, sides.where("NOT (taken AND not_taken)").select(*place, (~F.col("taken")).alias("missing"))


def edge_case_coverage(cases: DataFrame, traces: DataFrame, share: float = 0.3) -> DataFrame:
    """(case, covered, best) of cases(case, domain, keywords) on traces(trace, domain, text): the largest share of keywords that one trace of the domain has as words.

    Cases and traces meet by domain and word, never by domain alone.
    """
    size = cases.select("case", F.size(F.array_distinct("keywords")).alias("_n"))
    asked = cases.select("case", "domain", F.explode(F.array_distinct(F.transform("keywords", F.lower))).alias("word"))
    said = traces.select("trace", "domain", F.explode(F.array_distinct(F.split(F.lower("text"), "[^\\p{L}0-9]+"))).alias("word")).where("word <> ''")
    hits = said.join(asked, ["domain", "word"]).groupBy("case", "trace").agg(F.count("*").alias("hits")).groupBy("case").agg(F.max("hits").alias("hits"))
    best = F.coalesce(F.col("hits") / F.col("_n"), F.lit(0.0))
    return size.join(hits, "case", "left").select("case", (best > share).alias("covered"), best.alias("best"))


def observations(events: DataFrame, state: str = "value", write: str = "purchase", condition: str = "error") -> dict[str, DataFrame]:
    """Three kinds of observations: state changes (before, after) of each variable, writes with what was last seen of others, and conditions with what follows."""
    changes = events.withColumn("before", F.expr(f"lag({state}) OVER (PARTITION BY session_id, type ORDER BY seq)"))
    other = F.expr(f"last(CASE WHEN type <> '{write}' THEN {state} END, true) OVER ({BY_SEQ} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    follow = F.expr(f"lead(type) OVER ({BY_SEQ})")
    return {
        "changes": changes.where("before IS NOT NULL").select("session_id", "seq", F.col("type").alias("key"), F.col("before").alias("given"), F.col(state).alias("result")),
        "writes": events.withColumn("_o", other).where(F.col("type") == write).where("_o IS NOT NULL").select("session_id", "seq", F.lit(write).alias("key"), F.col("_o").alias("given"), F.col(state).alias("result")),
        "conditions": events.withColumn("_f", follow).where(F.col("type") == condition).where("_f IS NOT NULL").select("session_id", "seq", F.lit(condition).alias("key"), F.col(state).alias("given"), F.col("_f").alias("result")),
    }


def merged_rules(rules: DataFrame) -> DataFrame:
    """rules(id, category, inputs, outputs, confidence, support) of one category, inputs and outputs become one: the surest, with all support."""
    same = ["category", F.array_sort("inputs").alias("inputs"), F.array_sort("outputs").alias("outputs")]
    keyed = rules.select(*same, "id", "confidence", "support")
    return keyed.groupBy("category", "inputs", "outputs").agg(F.min_by("id", F.struct(-F.col("confidence"), "id")).alias("id"), F.max("confidence").alias("confidence"), F.sum("support").alias("support"), F.count("*").alias("merged"))


def suggested_tests(signatures: DataFrame) -> DataFrame:
    """(field, reason, value) of numeric fields(field, low, high): minimum, maximum, middle and zero; of texts the empty one."""
    text = lambda c: c.cast("string")
    rows = F.array(
        F.struct(F.lit("minimum").alias("reason"), text(F.col("low")).alias("value")), F.struct(F.lit("maximum").alias("reason"), text(F.col("high")).alias("value")),
        F.struct(F.lit("middle").alias("reason"), text((F.col("low") + F.col("high")) / 2).alias("value")), F.struct(F.lit("zero").alias("reason"), F.lit("0.0").alias("value")),
    )
    empty = F.array(F.struct(F.lit("empty").alias("reason"), F.lit("").alias("value")))
    return signatures.select("field", F.explode(F.when(F.col("low").isNotNull(), rows).otherwise(empty)).alias("x")).select("field", "x.*")


def functional_mappings(observations: DataFrame, key: str, given: str, result: str, inputs: int = 2, least: int = 3) -> DataFrame:
    """Keys under which equal inputs always gave equal outputs, for enough inputs and observations."""
    per_input = observations.groupBy(key, given).agg(F.count("*").alias("n"), F.count_distinct(result).alias("outputs"))
    return per_input.groupBy(key).agg(F.sum("n").alias("observations"), F.count("*").alias("inputs"), F.bool_and(F.col("outputs") == 1).alias("functional")).where(
        (F.col("inputs") >= inputs) & (F.col("observations") >= least)
    )


def guarded_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson's correlation; null for constant columns."""
    return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def formulas(df: DataFrame, inputs: Sequence[str], output: str, tolerance: float = 1e-4) -> DataFrame:
    """Which of identity, constant ratio and sum of two inputs hold for all rows."""
    y, checks = F.col(output), {}
    for a in inputs:
        checks[f"{output} = {a}"] = F.bool_and(F.abs(y - F.col(a)) <= tolerance)
        checks[f"{output} = k * {a}"] = F.coalesce(F.var_pop(F.try_divide(y, F.col(a))) < tolerance, F.lit(False))
    for i, a in enumerate(inputs):
        for b in inputs[i + 1 :]:
            checks[f"{output} = {a} + {b}"] = F.bool_and(F.abs(y - F.col(a) - F.col(b)) <= tolerance)
    wide = df.agg(*[v.alias(f"c{k}") for k, v in enumerate(checks.values())])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("formula"), F.col(f"c{k}").alias("holds")) for k, n in enumerate(checks)])).alias("x")).select("x.*")


def check_formula(df: DataFrame, expected: Column, output: str, tolerance: float = 0.01) -> DataFrame:
    """How many rows a formula (a Column, never evaluated text) explains."""
    ok = F.abs(F.col(output) - expected) <= tolerance
    return df.agg(F.count("*").alias("n"), F.count_if(ok).alias("matched"), F.count_if(~ok).alias("violated"))
