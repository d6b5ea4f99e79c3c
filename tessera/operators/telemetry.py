"""Telemetry, health and rollout in batch (O1-O25); streams are in tessera.streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of histogram buckets, in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def ingest(spans: DataFrame, allow: Sequence[str] = (), deny: Sequence[str] = (), min_duration: float = 0.0, errors_only: bool = False, kind: str = "type", duration: str = "value", error: Column | None = None) -> DataFrame:
    """O1: allow and deny lists, least duration, errors only."""
    if allow:
        spans = spans.where(F.col(kind).isin(*allow))
    if deny:
        spans = spans.where(~F.col(kind).isin(*deny))
    spans = spans.where(F.col(duration) >= min_duration)
    return spans.where(error) if errors_only and error is not None else spans


def cumulative(points: DataFrame, by: Sequence[str], order: Sequence[str], value: str, bucket: Column | None = None) -> DataFrame:
    """A counter as its running sum.

    With ``bucket``, a column that grows with ``order`` (a day of the time), a
    series is summed within its buckets and onto the sums of those before, so
    that a long series is spread over many tasks.
    """
    if bucket is None:
        return points.withColumn("total", F.expr(f"sum({value}) OVER (PARTITION BY {', '.join(by)} ORDER BY {', '.join(order)} ROWS UNBOUNDED PRECEDING)"))
    rows = points.withColumn("_bucket", bucket)
    sums = rows.groupBy(*by, "_bucket").agg(F.sum(value).alias("_sum"))
    before = sums.withColumn("_before", F.expr(f"coalesce(sum(_sum) OVER (PARTITION BY {', '.join(by)} ORDER BY _bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")).drop("_sum")
    within = rows.withColumn("_within", F.expr(f"sum({value}) OVER (PARTITION BY {', '.join(by)}, _bucket ORDER BY {', '.join(order)} ROWS UNBOUNDED PRECEDING)"))
    return within.join(before, [*by, "_bucket"]).withColumn("total", F.col("_before") + F.col("_within")).drop("_bucket", "_before", "_within")


def smf_spans(records: DataFrame) -> DataFrame:
    """records(record_type, ts, name, elapsed_ms, abend, aborts, return_code) of types 110, 101, 116 and 30 as spans.

    Transactions with an abend, database records with aborts and batch steps
    with a return code over 4 are errors; other types are left out.
    """
    kind = F.col("record_type")
    failed = F.when(kind == 110, F.col("abend").isNotNull()).when(kind == 101, F.coalesce(F.col("aborts") > 0, F.lit(False))).when(kind == 30, F.coalesce(F.col("return_code") > 4, F.lit(False))).otherwise(F.lit(False))
    subsystem = F.when(kind == 110, "cics").when(kind == 101, "db2").when(kind == 116, "mq").when(kind == 30, "batch")
    label = F.when(kind == 110, "CICS:").when(kind == 101, "DB2:").when(kind == 116, "MQ:").otherwise("BATCH:")
    end = F.when(kind != 116, F.expr("timestampadd(MILLISECOND, cast(elapsed_ms AS INT), ts)"))
    rows = records.where(kind.isin(110, 101, 116, 30))
    return rows.select(subsystem.alias("subsystem"), F.concat(label, "name").alias("operation"), F.col("ts").alias("start"), end.alias("end"), F.when(kind != 116, F.col("elapsed_ms")).alias("duration"), F.when(failed, "ERROR").otherwise("OK").alias("status"))


def smf_metrics(records: DataFrame) -> DataFrame:
    """Two metric points (metric, ts, value) of each record: 110 response and CPU time, 101 elapsed time and rows, 116 messages put and got."""
    pairs = {110: (("response_time", "elapsed_ms"), ("cpu_time", "cpu_ms")), 101: (("elapsed_time", "elapsed_ms"), ("rows_fetched", "rows")), 116: (("messages_put", "puts"), ("messages_got", "gets"))}
    rows = F.lit(None)
    for kind, metrics in pairs.items():
        points = F.array(*[F.struct(F.concat(F.lit({110: "cics.", 101: "db2.", 116: "mq."}[kind]), F.lit(m)).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in metrics])
        rows = F.when(F.col("record_type") == kind, points).otherwise(rows)
    return records.select("ts", F.explode(rows).alias("x")).select("x.metric", "ts", "x.value").where("value IS NOT NULL")


def bucket_counts(points: DataFrame, by: Sequence[str], value: str, bounds: Sequence[float] = BUCKETS) -> DataFrame:
    """Cumulative counts of values up to each bound, in one aggregate."""
    wide = points.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(F.col(value) <= b).alias(f"b{k}") for k, b in enumerate(bounds)])
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("count")) for k, b in enumerate(bounds)], F.struct(F.lit(None).cast("double").alias("le"), F.col("n").alias("count")))
    return wide.select(*by, F.explode(rows).alias("x")).select(*by, "x.*")


def normal_path(url: Column) -> Column:
    """UUIDs and numbers of a path become ``:id``."""
    # Fixed value.
    uuid = "/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    return F.regexp_replace(F.regexp_replace(url, uuid, "/:id"), "/[0-9]+", "/:id")


def floor_percentiles(points: DataFrame, by: Sequence[str], value: str, quantiles: Sequence[float], order: str, last: int = 1000) -> DataFrame:
    """Statistics of the last points; percentiles at index floor(n q). At most ``last`` values are held per series."""
    recent = points.withColumn("_r", F.expr(f"row_number() OVER (PARTITION BY {', '.join(by)} ORDER BY {order})")).where(F.col("_r") <= last)
    grouped = recent.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("v"), F.sum(value).alias("sum"), F.avg(value).alias("mean"))
    at = lambda q: F.element_at("v", F.least(F.floor(F.size("v") * q).cast("int") + 1, F.size("v")))
    return grouped.select(*by, F.size("v").cast("long").alias("n"), "sum", "mean", *[at(q).alias(f"p{int(q * 100)}") for q in quantiles])


def alerts(points: DataFrame, thresholds: DataFrame, metric: str, value: str) -> DataFrame:
    """Points against (metric, op, threshold) rows; thresholds are configuration, joined on the metric."""
    v, t, op = F.col(value), F.col("threshold"), F.col("op")
    hit = F.when(op == "gt", v > t).when(op == "lt", v < t).when(op == "gte", v >= t).when(op == "lte", v <= t).when(op == "eq", v == t)
    return points.join(thresholds, metric).where(hit)


def consecutive(checks: DataFrame, by: Sequence[str], order: Sequence[str], ok: str, failures: int = 3, successes: int = 2) -> DataFrame:
    """Runs of equal outcomes; unhealthy after ``failures`` in a row, healthy after ``successes``, else as before."""
    part, sort = ", ".join(by), ", ".join(order)
    marked = checks.withColumn("_new", F.expr(f"CASE WHEN {ok} <=> lag({ok}) OVER (PARTITION BY {part} ORDER BY {sort}) THEN 0 ELSE 1 END"))
    marked = marked.withColumn("_run", F.expr(f"sum(_new) OVER (PARTITION BY {part} ORDER BY {sort} ROWS UNBOUNDED PRECEDING)"))
    marked = marked.withColumn("streak", F.expr(f"row_number() OVER (PARTITION BY {part}, _run ORDER BY {sort})"))
    signal = F.when(~F.col(ok) & (F.col("streak") >= failures), "unhealthy").when(F.col(ok) & (F.col("streak") >= successes), "healthy")
    marked = marked.withColumn("_signal", signal)
    state = F.expr(f"coalesce(last(_signal, true) OVER (PARTITION BY {part} ORDER BY {sort} ROWS UNBOUNDED PRECEDING), 'unknown')")
    return marked.withColumn("state", state).drop("_new", "_run", "_signal")


def window_health(points: DataFrame, by: Sequence[str], ts: str, value: str, error: Column, width: str = "60 seconds", p99_limit: float = 100.0, error_limit: float = 0.01, available: float = 0.0, accuracy: int | None = None) -> DataFrame:
    """Tumbling windows: error rate and nearest-rank p99 against limits, and availability (1 - error rate) against ``available``.

    Critical at twice a limit or under nine tenths of the availability. With
    ``accuracy`` the percentile is a sketch of fixed size.
    """
    p99 = F.expr(f"percentile_disc(0.99) WITHIN GROUP (ORDER BY {value})") if accuracy is None else F.percentile_approx(value, 0.99, accuracy)
    grouped = points.groupBy(*by, F.window(F.col(ts).cast("timestamp"), width).alias("w")).agg(F.count("*").alias("n"), F.avg(F.when(error, 1.0).otherwise(0.0)).alias("error_rate"), p99.alias("p99"))
    worst, up = F.greatest(F.col("error_rate") / error_limit, F.col("p99") / p99_limit), 1 - F.col("error_rate")
    status = F.when((worst >= 2) | (up < 0.9 * available), "critical").when((worst > 1) | (up < available), "warning").otherwise("healthy")
    return grouped.select(*by, F.col("w.start").alias("start"), "n", "error_rate", "p99", up.alias("availability"), status.alias("status"))


#: Rank error of a merged KLL sketch of 200 levels that 99 of 100 estimates keep to.
KLL_ERROR = 0.0165


def percentile_sketches(points: DataFrame, by: Sequence[str], ts: str, value: str, width: str = "60 seconds") -> DataFrame:
    """(by, start, n, low, high, sketch) of tumbling windows: sketches of fixed size, to be stored and merged over any range.

    Null values and values that are no numbers take no part.
    """
    kept = points.where(F.col(value).isNotNull() & ~F.isnan(value))
    grouped = kept.groupBy(*by, F.window(F.col(ts).cast("timestamp"), width).alias("w"))
    sketched = grouped.agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.kll_sketch_agg_double(F.col(value).cast("double")).alias("sketch"))
    return sketched.select(*by, F.col("w.start").alias("start"), "n", "low", "high", "sketch")


def merged_percentiles(sketches: DataFrame, by: Sequence[Column | str], quantiles: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Count, extremes and percentiles of all points of each group of stored windows, from their sketches alone.

    A percentile's rank is within ``KLL_ERROR`` of what it says, however many windows are merged.
    """
    of = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("_sketch"))
    return of.withColumns({f"p{q * 100:g}": F.kll_sketch_get_quantile_double("_sketch", F.lit(float(q))) for q in quantiles}).drop("_sketch")


def java_hash(text: Column) -> Column:
    """F8: the 31-multiplier string hash over characters, as a signed 32-bit integer; built-in functions only."""
    wrapped = F.aggregate(F.split(text, ""), F.lit(0).cast("bigint"), lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(1 << 32)))
    return F.when(wrapped >= 1 << 31, wrapped - (1 << 32)).otherwise(wrapped)


def in_rollout(key: Column, percent: float) -> Column:
    """A stable share of keys by hash."""
    return F.abs(java_hash(key)) % 100 < percent


def variant(key: Column, weights: dict[str, int]) -> Column:
    """A weighted variant by stable hash; weights in percent, the rest has none."""
    place, low, out = F.abs(java_hash(key)) % 100, 0, F.lit(None).cast("string")
    for name, weight in weights.items():
        out = F.when((place >= low) & (place < low + weight), F.lit(name)).otherwise(out)
        low += weight
    return out


def flag_condition(condition: dict, key: Column) -> Column:
    """One of twelve operators on an attribute; a missing attribute meets not-equals, not-in and percentages alone."""
    c, v, op = F.col(condition.get("attribute", "")) if condition.get("attribute") else None, condition["value"], condition["operator"]
    if op == "percentage":
        return F.abs(java_hash(key)) % 100 < v
    made = {
        "equals": lambda: c == v, "not-equals": lambda: ~c.eqNullSafe(v), "contains": lambda: c.contains(v), "not-contains": lambda: ~c.contains(v), "in": lambda: c.isin(*v), "not-in": lambda: c.isNull() | ~c.isin(*v),
        "matches": lambda: c.rlike(v), "gt": lambda: c > v, "gte": lambda: c >= v, "lt": lambda: c < v, "lte": lambda: c <= v,
    }[op]()
    return F.coalesce(made, F.lit(False))


def by_weight(key: Column, weights: Sequence[tuple[str, int]]) -> Column:
    """A name by the key's hash modulo the sum of the weights; null where they are all 0."""
    total, low, out = sum(w for _, w in weights), 0, F.lit(None).cast("string")
    if not total:
        return out
    place = F.abs(java_hash(key)) % total
    for name, weight in weights:
        out = F.when((place >= low) & (place < low + weight), F.lit(name)).otherwise(out)
        low += weight
    return out


def evaluate_flag(flag: dict, key: Column) -> Column:
    """The value of a flag: the first rule by priority all of whose conditions hold, else a weighted variant, else the default.

    ``flag``: rules [{priority, conditions, variant}], variants {name: (weight, value)} and default. Rules that name
    no variant are passed over. Disabled flags give the default.
    """
    variants, default = flag["variants"], F.lit(flag["default"])
    if not flag.get("enabled", True):
        return default
    named = by_weight(key, [(n, w) for n, (w, _) in variants.items()])
    out = default
    for name, (_, value) in variants.items():
        out = F.when(named == name, F.lit(value)).otherwise(out)
    for rule in sorted(flag["rules"], key=lambda r: -r["priority"]):
        if rule["variant"] in variants:
            holds = F.lit(True)
            for c in rule["conditions"]:
                holds = holds & flag_condition(c, key)
            out = F.when(holds, F.lit(variants[rule["variant"]][1])).otherwise(out)
    return out


def routed(requests: DataFrame, routes: Sequence[dict], key: Column, session: str, order: str, sticky: bool = True) -> DataFrame:
    """Requests with ``target`` and ``reason``: the session's first target if ``sticky``, else the first route whose conditions hold, else by weight.

    ``routes``: [{target, weight, conditions}]; conditions as of flags. Null sessions are never sticky.
    """
    own, reason = by_weight(key, [(r["target"], r["weight"]) for r in routes]), F.lit("weight-based")
    for r in reversed(routes):
        if r.get("conditions"):
            holds = F.lit(True)
            for c in r["conditions"]:
                holds = holds & flag_condition(c, key)
            own, reason = F.when(holds, F.lit(r["target"])).otherwise(own), F.when(holds, "condition-match").otherwise(reason)
    placed = requests.withColumns({"target": own, "reason": reason})
    if not sticky:
        return placed
    firsts = placed.where(F.col(session).isNotNull()).groupBy(session).agg(F.min_by(F.struct("target", F.col(order).alias("at")), order).alias("_first"))
    joined = placed.join(firsts, session, "left")
    later = F.col("_first").isNotNull() & (F.col(order) > F.col("_first.at"))
    return joined.withColumns({"target": F.when(later, F.col("_first.target")).otherwise(F.col("target")), "reason": F.when(later, "sticky-session").otherwise(F.col("reason"))}).drop("_first")


def route_stats(routed_: DataFrame) -> DataFrame:
    """Requests and share by target and reason."""
    counts = routed_.groupBy("target", "reason").agg(F.count("*").alias("n"))
    return counts.join(counts.agg(F.sum("n").alias("_all"))).select("target", "reason", "n", (F.col("n") / F.col("_all") * 100).alias("percent"))


def strangler_route(path: Column, key: Column, rules: Sequence[dict], override: Column | None = None) -> Column:
    """struct(target, rule, shadow): of enabled rules the one of the longest matching glob; an override decides, else the key's hash against its share.

    ``rules``: [{name, pattern, percent, shadow, enabled}]. Without a rule the target is legacy.
    """
    def chosen(rule: dict) -> Column:
        target = F.when(F.abs(java_hash(key)) % 100 < rule["percent"], "modern").otherwise("legacy")
        if override is not None:
            target = F.when(override.isin("legacy", "modern"), override).otherwise(target)
        other = F.when(target == "legacy", "modern").otherwise("legacy") if rule.get("shadow") else F.lit(None).cast("string")
        return F.struct(target.alias("target"), F.lit(rule["name"]).alias("rule"), other.alias("shadow"))

    none = F.lit(None).cast("string")
    out = F.struct(F.lit("legacy").alias("target"), none.alias("rule"), none.alias("shadow"))
    for rule in sorted((r for r in rules if r.get("enabled", True)), key=lambda r: len(r["pattern"])):
        glob = "".join(".*" if ch == "*" else "." if ch == "?" else ch if ch.isalnum() else f"\\{ch}" for ch in rule["pattern"])
        out = F.when(path.rlike(f"^{glob}$"), chosen(rule)).otherwise(out)
    return out


def pipeline_metrics(tasks: DataFrame, by: Sequence[str] = (), hours: float = 24.0) -> DataFrame:
    """tasks(status, retries) by group: retries, completed, failed, being healed, and completed ones an hour."""
    done = F.count_if(F.col("status") == "completed")
    return tasks.groupBy(*by).agg(F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"), done.alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "healing").alias("healing"), (done / hours).alias("throughput"))


def weighted_mean(weights: DataFrame, by: Sequence[str], value: str, samples: str | None) -> DataFrame:
    """Layer weights over clients: by samples, or plain."""
    mean = F.avg(value) if samples is None else F.try_divide(F.sum(F.col(value) * F.col(samples)), F.sum(samples))
    return weights.groupBy(*by).agg(mean.alias("weight"))


def retry_delay(attempt: Column, initial: float, factor: float, most: float) -> Column:
    """milliseconds before an attempt (from 0): growing by ``factor``, at most ``most``; without jitter, so that reruns agree."""
    return F.round(F.least(initial * F.pow(F.lit(float(factor)), attempt), F.lit(float(most)))).cast("long")


def retryable(message: Column, patterns: Sequence[str] = ()) -> Column:
    """whether an error's message matches any pattern, in any case; without patterns all errors are."""
    return message.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(True)


def merged_series(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Points of both, each under its series ``name:subsystem``."""
    return existing.unionByName(new).withColumn("series", F.concat_ws(":", "name", "subsystem"))


def promotion(checks: DataFrame, by: Sequence[str], criteria: Sequence[Column], critical: Column) -> DataFrame:
    """Promote where every criterion (an aggregate) holds, roll back on any critical check."""
    every = F.lit(True)
    for c in criteria:
        every = every & c
    return checks.groupBy(*by).agg(every.alias("promote"), F.bool_or(critical).alias("rollback"))


def dashboard(rows: DataFrame, ts: str, measures: dict[str, Column], period: str = "month") -> DataFrame:
    """Measures by period."""
    return rows.groupBy(F.date_trunc(period, ts).alias("period")).agg(*[c.alias(k) for k, c in measures.items()])
