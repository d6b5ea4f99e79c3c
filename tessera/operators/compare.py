"""Comparison of two systems' outputs, effects and traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import checkpointed, release
from tessera.operators.quality import union_all

# Texts that count as null.
NULL_TEXTS = ("", "null", "NULL", "None", "undefined", "N/A")


def normal_text(c: Column) -> Column:
    """Trimmed, white space collapsed, lower case."""
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))


def null_like(c: Column) -> Column:
    return c.isNull() | c.isin(*NULL_TEXTS)


def numeric_severity(a: Column, b: Column, tolerance: float = 1e-4, critical: float = 1.0) -> Column:
    """Null if equal within the tolerance (NaN equals NaN), else warning, or critical over ``critical``."""
    both_nan = F.isnan(a) & F.isnan(b)
    delta = F.abs(a - b)
    return F.when(a.isNull() & b.isNull() | both_nan, None).when(a.isNull() | b.isNull(), "critical").when(delta <= tolerance, None).when(delta > critical, "critical").otherwise("warning")


def text_severity(a: Column, b: Column) -> Column:
    """Null if equal or both null-like, info if only white space or case differs, else warning."""
    return F.when(null_like(a) & null_like(b), None).when(a.eqNullSafe(b), None).when(null_like(a) | null_like(b), "warning").when(normal_text(a) == normal_text(b), "info").otherwise("warning")


def date_severity(a: Column, b: Column) -> Column:
    """Critical if one is no date, info on the same day, else warning."""
    x, y = F.try_to_timestamp(a), F.try_to_timestamp(b)
    return F.when(a.eqNullSafe(b), None).when(x.isNull() | y.isNull(), "critical").when(x == y, None).when(F.to_date(x) == F.to_date(y), "info").otherwise("warning")


def keyed_diff(legacy: DataFrame, modern: DataFrame, keys: Sequence[str], numeric: Sequence[str] = (), texts: Sequence[str] = (), tolerance: float = 1e-4) -> DataFrame:
    """Full outer join by key; a row for every difference (keys, field, kind, severity).

    Missing rows are critical, added ones warnings.
    """
    a = legacy.select(*keys, F.lit(True).alias("in_a"), *[F.col(c).alias(f"a_{c}") for c in (*numeric, *texts)])
    b = modern.select(*keys, F.lit(True).alias("in_b"), *[F.col(c).alias(f"b_{c}") for c in (*numeric, *texts)])
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    found = [
        F.when(F.col("in_b").isNull(), F.struct(F.lit("*").alias("field"), F.lit("missing").alias("kind"), F.lit("critical").alias("severity"))),
        F.when(F.col("in_a").isNull(), F.struct(F.lit("*").alias("field"), F.lit("added").alias("kind"), F.lit("warning").alias("severity"))),
    ]
    for c in (*numeric, *texts):
        severity = numeric_severity(F.col(f"a_{c}").cast("double"), F.col(f"b_{c}").cast("double"), tolerance) if c in numeric else text_severity(F.col(f"a_{c}"), F.col(f"b_{c}"))
        found.append(F.when(both & severity.isNotNull(), F.struct(F.lit(c).alias("field"), F.lit("changed").alias("kind"), severity.alias("severity"))))
    joined = a.join(b, list(keys), "full_outer")
    return joined.select(*keys, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select(*keys, "x.*")


def array_difference(a: Column, b: Column) -> Column:
    """-2 if the lengths differ, else the first place (from 0) at which elements differ, else -1."""
    places = F.transform(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same, i: F.when(~same, i))
    first = F.try_element_at(F.filter(places, lambda p: p.isNotNull()), F.lit(1))
    return F.when(F.size(a) != F.size(b), F.lit(-2)).otherwise(F.coalesce(first, F.lit(-1)))


def same_multiset(a: Column, b: Column) -> Column:
    """Unordered arrays are equal as multisets."""
    return F.array_sort(a) == F.array_sort(b)


def match_effects(legacy: DataFrame, modern: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The n-th effect of a key meets the n-th of the other side; missing, added, modified or matched."""
    numbered = lambda df, name: df.select(*keys, F.col(value).alias(name), F.expr(f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {', '.join(order)})").alias("nth"))
    a, b = numbered(legacy, "a").withColumn("in_a", F.lit(True)), numbered(modern, "b").withColumn("in_b", F.lit(True))
    status = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "added").when(F.col("a").eqNullSafe(F.col("b")), "matched").otherwise("modified")
    return a.join(b, [*keys, "nth"], "full_outer").select(*keys, "nth", status.alias("status"))


def effect_severity(kind: Column, status: Column) -> Column:
    """How grave an effect's status is: lost or changed database and network effects are critical; null if matched."""
    vital = kind.isin("database", "network")
    return (
        F.when(status == "matched", None).when(vital & status.isin("missing", "modified"), "critical").when(status.isin("added", "modified"), "warning")
        .when(kind == "log", "info").otherwise("warning")
    )


def branch_diff(legacy: DataFrame, modern: DataFrame, place: Sequence[str]) -> DataFrame:
    """``place`` (file, line, condition) with the outcomes that each side took where they differ; null: never reached."""
    sides = [df.groupBy(*place).agg(F.array_sort(F.collect_set("outcome")).alias(name)) for df, name in ((legacy, "legacy"), (modern, "modern"))]
    joined = sides[0].join(sides[1], list(place), "full_outer")
    return joined.where(~F.col("legacy").eqNullSafe(F.col("modern")))


def call_diff(legacy: DataFrame, modern: DataFrame, session: str = "session_id", call: str = "type", seq: str = "seq") -> DataFrame:
    """Calls of each session by their place; (session, place, status): missing, added or different."""
    numbered = lambda df, name: df.select(session, F.col(call).alias(name), F.expr(f"row_number() OVER (PARTITION BY {session} ORDER BY {seq})").alias("place"))
    joined = numbered(legacy, "a").join(numbered(modern, "b"), [session, "place"], "full_outer")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "different")
    return joined.select(session, "place", status.alias("status")).where("status IS NOT NULL")


def memory_diff(legacy: DataFrame, modern: DataFrame, keys: Sequence[str], value: str = "value", seq: str = "seq") -> DataFrame:
    """Variables whose last value differs, with both."""
    last = lambda df, name: df.groupBy(*keys).agg(F.max_by(value, seq).alias(name))
    return last(legacy, "legacy").join(last(modern, "modern"), list(keys), "full_outer").where(~F.col("legacy").eqNullSafe(F.col("modern")))


def set_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side alone, with the side."""
    return a.distinct().subtract(b.distinct()).withColumn("side", F.lit("legacy")).unionByName(b.distinct().subtract(a.distinct()).withColumn("side", F.lit("modern")))


def report(total: Column, passed: Column, critical: Column) -> list[Column]:
    """Rate, confidence (log of the volume and rate), status and risk."""
    rate = F.coalesce(F.try_divide(passed, total), F.lit(0.0))
    volume = F.least(F.lit(1.0), F.log10(total + 1) / 2)
    confidence = volume * 0.3 + rate * 0.7
    status = F.when(rate >= 0.99, "equivalent").when(rate >= 0.95, "mostly-equivalent").otherwise("different")
    risk = F.when(critical > 0, "critical").when(rate < 0.95, "high").when(rate < 0.99, "medium").otherwise("low")
    return [rate.alias("rate"), confidence.alias("confidence"), status.alias("status"), risk.alias("risk")]


def latency_summary(df: DataFrame, value: str, group: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """Count, mean, extremes and nearest-rank percentiles.

    Exact percentiles hold every distinct value of a group in one task; with
    ``accuracy`` a sketch of fixed size takes their place.
    """
    exact = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")
    p = [(exact(q) if accuracy is None else F.percentile_approx(value, q, accuracy)).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)]
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), *p)


def top_k(df: DataFrame, by: Sequence[str], k: int, example: str | None = None, examples: int = 3) -> DataFrame:
    """The most frequent values of ``by``, with the smallest few examples; ties to the smaller value.

    Examples are sought for those ``k`` values alone, and each task hands on
    its smallest few of each.
    """
    top = df.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by).limit(k)
    if not example:
        return top
    hits = df.join(F.broadcast(top.select(*by)), list(by), "left_semi")
    hits = hits.withColumn("_r", F.expr(f"row_number() OVER (PARTITION BY {', '.join(by)} ORDER BY {example})")).where(F.col("_r") <= examples)
    texts = hits.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(example)).cast("array<string>"), ",").alias("examples"))
    return top.join(texts, list(by), "left").orderBy(F.desc("n"), *by)


def relative_severity(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Major beyond a relative tolerance, minor below it, null if equal, critical if missing."""
    return F.when(a.eqNullSafe(b), None).when(a.isNull() | b.isNull(), "critical").when(F.abs(a - b) > F.abs(a) * tolerance, "major").otherwise("minor")


def decimal_kind(a: Column, b: Column) -> Column:
    """What a numeric difference looks like."""
    return (
        F.when(a == b, "equal").when(F.floor(a) == b, "truncation").when(F.round(a, 0) == b, "rounding").when(F.abs(a - b) < 0.01, "precision-loss").otherwise("value")
    )


def text_kind(a: Column, b: Column) -> Column:
    """What a difference of texts looks like: padding lost, or other characters."""
    return F.when(a.eqNullSafe(b), "equal").when(a.isNull() | b.isNull(), "output-mismatch").when(F.trim(a) == F.trim(b), "truncation").otherwise("character-encoding")


def output_severity(a: Column, b: Column) -> Column:
    """Cosmetic, minor or major of two numbers."""
    delta = F.abs(a - b)
    return F.when(a == b, None).when(delta < 0.01, "cosmetic").when(delta < 1, "minor").otherwise("major")


def json_kind(value: Column) -> Column:
    """The kind of a JSON text: null, boolean, number (whole or not), string, array or object; null counts as missing."""
    v = F.trim(value)
    return (
        F.when(v.isNull() | v.isin("null", "undefined"), "null").when(v.isin("true", "false"), "boolean").when(v.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), "number")
        .when(v.startswith("{"), "object").when(v.startswith("["), "array").otherwise("string")
    )


def type_severity(a: Column, b: Column) -> Column:
    """Critical where two JSON values are of different kinds, else null."""
    return F.when(json_kind(a) != json_kind(b), "critical")


def token_overlap(a: Column, b: Column) -> Column:
    """Shared words over the longer list."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b), F.lit(1))


def _document(json: str) -> Column:
    """A JSON text as VARIANT; what is no JSON is a string."""
    return F.coalesce(F.try_parse_json(json), F.col(json).cast("variant"))


def _children(df: DataFrame, value: str, outer: bool = False) -> DataFrame:
    """``df`` with ``_pos``, ``_name`` and ``_child``: a row for each member or element of the VARIANT ``value``; with ``outer`` one of nulls where there is none."""
    tvf = df.sparkSession.tvf
    return df.lateralJoin((tvf.variant_explode_outer if outer else tvf.variant_explode)(F.col(value).outer()).toDF("_pos", "_name", "_child"))


def _step(path: Column) -> Column:
    """The path of a child: members by name, in brackets and quotes unless they are plain, elements by place."""
    plain = F.concat(F.when(path != "", F.concat(path, F.lit("."))).otherwise(path), F.col("_name"))
    quoted = F.concat(path, F.lit("['"), F.replace("_name", F.lit("'"), F.lit("\\'")), F.lit("']"))
    return F.when(F.col("_name").isNull(), F.concat(path, F.lit("["), F.col("_pos").cast("string"), F.lit("]"))).when(F.col("_name").rlike("^[A-Za-z0-9_]+$"), plain).otherwise(quoted)


def leaves(df: DataFrame, key: str, json: str, cut=checkpointed) -> DataFrame:
    """(key, path, value) of every leaf of a JSON document, to any depth and into arrays.

    Documents are parsed once to VARIANT and exploded a level a round until
    nothing nested is left. Empty objects and arrays are leaves; JSON nulls have
    null values; a text that is no JSON is a leaf of its own.
    """
    level, out = df.select(key, F.lit("$").alias("path"), _document(json).alias("v")), []
    while True:
        # Rows without children are leaves.
        rows = cut(_children(level, "v", outer=True))
        value = F.when(F.is_variant_null("v"), None).otherwise(F.coalesce(F.try_variant_get("v", "$", "string"), F.to_json("v")))
        out.append(rows.where("_pos IS NULL").select(key, "path", F.when(F.col("v").isNotNull(), value).alias("value")))
        level = rows.where("_pos IS NOT NULL").select(key, _step(F.col("path")).alias("path"), F.col("_child").alias("v"))
        if level.isEmpty():
            return union_all(out)


def deep_compare(legacy: DataFrame, modern: DataFrame, key: str, json: str, tolerance: float = 0.001, ignore: Sequence[str] = (), fold: bool = True) -> DataFrame:
    """(key, path, status) of every leaf of either side: equal, different, missing or added.

    Numbers are equal within ``tolerance``, texts after trimming and, with
    ``fold``, in any case. Paths in ``ignore`` are left out.
    """
    both = [leaves(df, key, json).where(~F.col("path").isin(*ignore)).withColumnRenamed("value", name).withColumn(f"in_{name}", F.lit(True)) for df, name in ((legacy, "a"), (modern, "b"))]
    a, b = F.col("a"), F.col("b")
    x, y = a.try_cast("double"), b.try_cast("double")
    text = (lambda c: F.lower(F.trim(c))) if fold else F.trim
    same = F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= tolerance).otherwise(text(a).eqNullSafe(text(b)))
    status = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "added").when(same, "equal").otherwise("different")
    return both[0].join(both[1], [key, "path"], "full_outer").select(key, "path", status.alias("status"))


def variant_kind(v: Column) -> Column:
    """null, object, array, number, string or boolean of a VARIANT."""
    said = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | F.is_variant_null(v), "null").when(said.startswith("OBJECT"), "object").when(said.startswith("ARRAY"), "array")
        .when(said == "STRING", "string").when(said == "BOOLEAN", "boolean").otherwise("number")
    )


def differences(legacy: DataFrame, modern: DataFrame, key: str, json: str, tolerance: float = 0.001, strings: str = "exact", arrays: str = "ordered", ignore: Sequence[str] = (), cut=checkpointed) -> DataFrame:
    """(key, path, type, severity) of what differs between two documents of a key, from the top down.

    Types are ``value-mismatch``, ``type-mismatch`` (kinds differ), ``missing``
    and ``extra`` (null or absent on one side). A difference is said once,
    where it begins: nothing below a missing member is listed. All are critical
    but members that only the modern side has, which are warnings. Numbers may
    differ by ``tolerance``; ``strings`` are compared exact, after ``trim`` or
    with ``fold`` in any case; ``arrays`` by place (``ordered``) or as multisets
    (``unordered``, one difference for the whole array). The top is ``root``;
    paths in ``ignore`` are left out with all below.

    Both sides walk down together, a level a round, to any depth. Parts that
    are equal as a whole are left behind at once, so the work follows what
    differs.
    """
    sides = [df.select(key, _document(json).alias(name)) for df, name in ((legacy, "a"), (modern, "b"))]
    level = sides[0].join(sides[1], key, "full_outer").select(key, F.lit("").alias("path"), "a", "b", F.lit(True).alias("in_a"), F.lit(True).alias("in_b"))
    text = {"exact": lambda c: c, "trim": F.trim, "fold": F.lower}[strings]
    a, b, ka, kb = F.col("a"), F.col("b"), F.col("ka"), F.col("kb")
    get = lambda v, kind: F.try_variant_get(v, "$", kind)
    members = lambda v: F.array_sort(F.transform(get(v, "array<variant>"), lambda x: F.coalesce(F.to_json(x), F.lit("null"))))
    out = []
    while True:
        rows = level.where(~F.coalesce(F.to_json("a") == F.to_json("b"), F.lit(False)) & ~F.col("path").isin(*ignore))
        rows = cut(rows.withColumns({"ka": variant_kind(a), "kb": variant_kind(b)}))
        value = (
            F.when(ka == "number", F.abs(get(a, "double") - get(b, "double")) > tolerance).when(ka == "string", text(get(a, "string")) != text(get(b, "string")))
            .when(ka == "boolean", F.lit(True)).when(ka == "array", (members(a) != members(b)) if arrays == "unordered" else F.lit(False)).otherwise(F.lit(False))
        )
        kind = (
            F.when(~F.col("in_a"), "extra").when(~F.col("in_b"), "missing").when((ka == "null") & (kb == "null"), None).when(ka == "null", "extra").when(kb == "null", "missing")
            .when(ka != kb, "type-mismatch").when(value, "value-mismatch")
        )
        path = F.when(F.col("path") == "", "root").otherwise(F.col("path"))
        out.append(rows.select(key, path.alias("path"), kind.alias("type"), F.when(~F.col("in_a"), "warning").otherwise("critical").alias("severity")).where("type IS NOT NULL"))
        nested = rows.where((ka == kb) & ka.isin("object", *(["array"] if arrays == "ordered" else []))).where("in_a AND in_b")
        if nested.isEmpty():
            return union_all(out)
        left = _children(nested.select(key, "path", "a", "ka"), "a").select(key, _step(F.col("path")).alias("path"), F.col("_child").alias("a"), F.col("ka").alias("kind_a"))
        right = _children(nested.select(key, "path", "b", "kb"), "b").select(key, _step(F.col("path")).alias("path"), F.col("_child").alias("b"), F.col("kb").alias("kind_b"))
        # An absent member of an object is missing; an absent element of an array counts as null.
        here = lambda own, other: F.col(f"kind_{own}").isNotNull() | (F.col(f"kind_{other}") == "array")
        level = left.join(right, [key, "path"], "full_outer").select(key, "path", "a", "b", here("a", "b").alias("in_a"), here("b", "a").alias("in_b"))


def last_divergent(results: DataFrame, order: str, count: int = 10) -> DataFrame:
    """The newest results that are not equivalent."""
    return results.where("NOT equivalent").orderBy(F.desc(order)).limit(count)


def replay_rates(results: DataFrame) -> DataFrame:
    """``results(status, legacy_ms, modern_ms)``: percent of each status, mean latencies, mean speedup, improvement in percent."""
    share = lambda s: F.coalesce(F.try_divide(F.count_if(F.col("status") == s) * 100.0, F.count("*")), F.lit(0.0)).alias(f"{s}_percent")
    old, new = F.avg("legacy_ms"), F.avg("modern_ms")
    return results.agg(
        F.count("*").alias("n"), share("success"), share("mismatch"), share("error"), F.min("modern_ms").alias("low"), F.max("modern_ms").alias("high"), new.alias("mean"),
        F.avg(F.try_divide("legacy_ms", "modern_ms")).alias("speedup"), F.try_divide((old - new) * 100, old).alias("improvement"), F.try_divide(new, old).alias("ratio"),
    )


#: Choices of one group that are made at a time, and candidates of them.
TURNS, CANDIDATES = 20_000, 2_000_000


def _in_turn():
    """(a, b, score) of lists: in order of ``a`` each takes the least free ``b`` of the best classes of its own class's candidates. Made here, it is sent to the tasks as it is."""
    def choose(a, ka, b, kb, sa, sb, score):
        free, tiers, out = {}, {}, []
        for y, k in sorted(zip(b, kb), reverse=True):
            free.setdefault(k, []).append(y)
        for x, k, of in sorted(zip(score, sa, sb)):
            tier = tiers.setdefault(k, [])
            if not tier or tier[-1][0] != x:
                tier.append((x, []))
            tier[-1][1].append(of)
        for x, k in sorted(zip(a, ka)):
            tier = tiers[k]
            while tier:
                best, classes = tier[-1]
                classes[:] = [c for c in classes if free.get(c)]
                if classes:
                    out.append((x, free[min(classes, key=lambda c: free[c][-1])].pop(), best))
                    break
                tier.pop()
        return out

    return choose


def class_matches(legacy: DataFrame, modern: DataFrame, scores: DataFrame, by: Sequence[str], least: float = 0.3, direct: float = 0.7, cut=checkpointed) -> DataFrame:
    """:func:`greedy_matches` of ``legacy(by, a, ka)`` with ``modern(by, b, kb)`` in classes of equal fragments: ``scores(by, ka, kb, score)`` has a row for two classes.

    A choice depends on all before it, so those of a group are made one after
    another, but ``TURNS`` of them with ``CANDIDATES`` rows of scores at most at
    a time: every round takes the next part of all groups at once, with what
    the parts before have left.
    """
    by = list(by)
    scores = cut(scores.where(F.col("score") > least).select(*by, "ka", "kb", "score"))
    keys = ", ".join(f"`{c}`" for c in by)
    counted = legacy.where("a IS NOT NULL").join(scores.groupBy(*by, "ka").agg(F.count("*").alias("_n")), [*by, "ka"])
    turn, before = F.expr(f"row_number() OVER (PARTITION BY {keys} ORDER BY a) - 1"), F.expr(f"sum(_n) OVER (PARTITION BY {keys} ORDER BY a ROWS UNBOUNDED PRECEDING) - _n")
    turns = cut(counted.select(*by, "a", "ka", F.greatest(F.floor(turn / TURNS), F.floor(before / CANDIDATES)).alias("_part")))
    modern = cut(modern.where("b IS NOT NULL").select(*by, "b", "kb"))
    schema = f"array<struct<a: {turns.schema['a'].dataType.simpleString()}, b: {modern.schema['b'].dataType.simpleString()}, score: double>>"
    last, found = turns.agg(F.max("_part")).first()[0], None
    for part in range((-1 if last is None else last) + 1):
        here = turns.where(F.col("_part") == part)
        of = scores.join(here.select(*by, "ka").distinct(), [*by, "ka"], "left_semi") if last else scores
        free = modern if found is None else modern.join(found.select(*by, "b"), [*by, "b"], "left_anti")
        # No class gives more of its fragments than there are turns.
        free = free.join(of.select(*by, "kb").distinct(), [*by, "kb"], "left_semi").withColumn("_place", F.expr(f"row_number() OVER (PARTITION BY {keys}, kb ORDER BY b)")).where(F.col("_place") <= TURNS)
        lists = lambda df, *columns: df.groupBy(*by).agg(*[F.collect_list(c).alias(f"_{name}") for name, c in columns])
        rows = lists(here, ("a", "a"), ("ka", "ka")).join(lists(free, ("b", "b"), ("kb", "kb")), by).join(lists(of, ("sa", "ka"), ("sb", "kb"), ("score", "score")), by)
        made = rows.select(*by, F.explode(F.udf(_in_turn(), schema)(*[f"_{c}" for c in ("a", "ka", "b", "kb", "sa", "sb", "score")])).alias("x")).select(*by, "x.*")
        before, found = found, cut(made if found is None else found.unionByName(made))
        if before is not None:
            release(before)
    if found is None:
        found = cut(legacy.join(modern, by).limit(0).select(*by, "a", "b", F.lit(0.0).alias("score")))
    release(scores, turns, modern)
    return found.withColumn("kind", F.when(F.col("score") > direct, "direct").otherwise("refactored"))


def greedy_matches(scores: DataFrame, by: Sequence[str], least: float = 0.3, direct: float = 0.7, cut=checkpointed) -> DataFrame:
    """``scores(by, a, b, score)``: in order of ``a`` each takes its best ``b`` over ``least`` not yet taken, of equal ones the first.

    Returns by, a, b, score and kind: direct over ``direct``, else refactored.
    Where many fragments are equal, :func:`class_matches` needs no row for each pair of them.
    """
    pairs = cut(scores.where(F.col("score") > least).select(*by, "a", "b", F.col("score").cast("double").alias("score")))
    a, b = (pairs.select(*by, c, F.col(c).alias(f"k{c}")).distinct() for c in ("a", "b"))
    found = class_matches(a, b, pairs.withColumnsRenamed({"a": "ka", "b": "kb"}), by, least, direct, cut)
    release(pairs)
    return found


def code_fragments(lines: DataFrame, key: str, starts: str, ends: str) -> DataFrame:
    """(key, start_line, end_line, content) of ``lines(key, line_no, line)`` cut where a line opens a block and after one that closes it.

    A line that begins a fragment never closes it, so within a run of closing
    lines every other one begins anew. Two running windows say so: each line
    looks back to the last one whose part is certain.
    """
    text = F.trim("line")
    before = f"PARTITION BY {key} ORDER BY line_no"
    marked = lines.select(key, "line_no", "line", text.rlike(starts).alias("_opens"), text.rlike(ends).alias("_closes"))
    marked = marked.withColumn("_open_end", F.expr(f"lag(_closes) OVER ({before})"))
    sure = F.col("_open_end").isNull() | F.col("_opens") | ~F.col("_open_end")
    first = F.col("_opens") | F.col("_open_end").isNull()
    marked = marked.withColumn("_sure", F.when(sure, F.struct("line_no", first.alias("first")))).withColumn("_last", F.expr(f"last(_sure, true) OVER ({before})"))
    begins = F.col("_last.first") == ((F.col("line_no") - F.col("_last.line_no")) % 2 == 0)
    numbered = marked.withColumn("_begins", begins.cast("int")).withColumn("_fragment", F.expr(f"sum(_begins) OVER ({before})"))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return numbered.groupBy(key, "_fragment").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), content.alias("content")).drop("_fragment")


def fragment_scores(legacy: DataFrame, modern: DataFrame, key: str) -> DataFrame:
    """(key, a, b, score) of fragments of a key that share a word of three letters or more: shared words over those of the longer.

    ``a`` and ``b`` are their first lines. Fragments of a key meet with all their words, so that no
    row for a word that two of them share goes through a shuffle.
    """
    def words(df: DataFrame, name: str) -> DataFrame:
        plain = F.regexp_replace(F.lower("content"), "[^a-z0-9]", " ")
        found = F.array_distinct(F.filter(F.split(plain, " +"), lambda w: F.length(w) > 2))
        return df.select(key, F.col("start_line").alias(name), found.alias(f"w{name}"))

    met = words(legacy, "a").join(words(modern, "b"), key).select(key, "a", "b", F.size(F.array_intersect("wa", "wb")).alias("_n"), F.greatest(F.size("wa"), F.size("wb")).alias("_of"))
    return met.where("_n > 0").select(key, "a", "b", (F.col("_n") / F.col("_of")).alias("score"))


def rule_mappings(legacy: DataFrame, modern: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, rule, a, b, kind) by ``rules(key, rule, name, first_line, last_line)``: legacy fragments of its lines with modern ones that hold its name.

    Fragments are paired in order, the shorter side's first standing in for what it lacks. One with one is
    direct, one with several split, several with one merged, else refactored.
    """
    name = F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")
    old = legacy.join(rules, key).where((F.col("start_line") <= F.col("last_line")) & (F.col("end_line") >= F.col("first_line"))).select(key, "rule", F.col("start_line").alias("a"))
    new = modern.join(rules, key).where(F.contains(F.lower("content"), name)).select(key, "rule", F.col("start_line").alias("b"))
    place = lambda df, c: df.withColumn("_i", F.expr(f"row_number() OVER (PARTITION BY {key}, rule ORDER BY {c})"))
    count = lambda df, n: df.groupBy(key, "rule").agg(F.count("*").alias(n), F.min("a" if n == "_na" else "b").alias(f"{n}_first"))
    both = place(old, "a").join(place(new, "b"), [key, "rule", "_i"], "full_outer").join(count(old, "_na"), [key, "rule"]).join(count(new, "_nb"), [key, "rule"])
    one, other = F.col("_na") == 1, F.col("_nb") == 1
    kind = F.when(one & other, "direct").when(one, "split").when(other, "merged").otherwise("refactored")
    return both.select(key, "rule", F.coalesce("a", "_na_first").alias("a"), F.coalesce("b", "_nb_first").alias("b"), kind.alias("kind"))


def code_mappings(legacy: DataFrame, modern: DataFrame, key: str, rules: DataFrame | None = None, cut=checkpointed) -> DataFrame:
    """(key, rule, a, b, kind, confidence): fragments paired by rules, then those left over by likeness."""
    scores = cut(fragment_scores(legacy, modern, key))
    named = rule_mappings(legacy, modern, rules, key) if rules is not None else None
    free = scores
    if named is not None:
        named = cut(named.join(scores, [key, "a", "b"], "left").select(key, "rule", "a", "b", "kind", F.coalesce("score", F.lit(0.0)).alias("confidence")))
        free = free.join(named.select(key, "a").distinct(), [key, "a"], "left_anti").join(named.select(key, "b").distinct(), [key, "b"], "left_anti")
    rule_type = rules.schema["rule"].dataType if rules is not None else "string"
    alike = greedy_matches(free.select(key, "a", "b", "score"), [key], cut=cut).select(key, F.lit(None).cast(rule_type).alias("rule"), "a", "b", "kind", F.col("score").alias("confidence"))
    release(scores)
    return alike if named is None else named.unionByName(alike)


def risk_areas(mappings: DataFrame, legacy: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """(key, start_line, level, reason): mappings of a confidence under 0.5 (high under 0.3), and legacy fragments without mapping that hold rules (critical)."""
    weak = mappings.where("confidence < 0.5").select(
        key, F.col("a").alias("start_line"), F.when(F.col("confidence") < 0.3, "high").otherwise("medium").alias("level"), F.concat(F.lit("Low confidence mapping ("), F.floor(F.col("confidence") * 100 + 0.5).cast("string"), F.lit("%)")).alias("reason"),
    )
    unmapped = legacy.join(mappings.select(key, F.col("a").alias("start_line")).distinct(), [key, "start_line"], "left_anti")
    held = unmapped.join(rules, key).where((F.col("start_line") <= F.col("last_line")) & (F.col("end_line") >= F.col("first_line"))).groupBy(key, "start_line").agg(F.count("*").alias("_n"))
    lost = held.select(key, "start_line", F.lit("critical").alias("level"), F.concat(F.lit("Unmapped legacy code contains "), F.col("_n").cast("string"), F.lit(" business rule(s)")).alias("reason"))
    return weak.unionByName(lost)


def mapping_summary(mappings: DataFrame, legacy: DataFrame, key: str) -> DataFrame:
    """A row for each key of ``legacy``: mappings by kind, mean confidence, and the percentage of legacy lines mapped (a fragment counts in each of its mappings)."""
    size = legacy.select(key, F.col("start_line").alias("a"), (F.col("end_line") - F.col("start_line") + 1).alias("_lines"))
    kinds = ("direct", "refactored", "split", "merged")
    of = mappings.join(size, [key, "a"]).groupBy(key).agg(F.count("*").alias("mappings"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.avg("confidence").alias("mean_confidence"), F.sum("_lines").alias("_mapped"))
    all_ = size.groupBy(key).agg(F.sum("_lines").alias("_all")).join(of, key, "left").fillna(0, ["mappings", *kinds, "mean_confidence", "_mapped"])
    return all_.select(key, "mappings", *kinds, "mean_confidence", F.floor(F.col("_mapped") / F.col("_all") * 100 + 0.5).alias("coverage"))


def trace_statistics(events: DataFrame, place: Sequence[str], taken: str) -> DataFrame:
    """Branch coverage in percent (100 without branches) and the number of places."""
    from tessera.operators.traces import branch_coverage

    return branch_coverage(events, place, taken)[0].select("coverage", "locations")


def aligned(legacy: DataFrame, modern: DataFrame, by: Sequence[str], order: Sequence[str], value: str, tolerance: float = 0.001) -> DataFrame:
    """One row (positions, unmatched, different): events of each group by place, values within a tolerance."""
    number = lambda df, name: df.select(*by, F.col(value).alias(name), F.lit(True).alias(f"in_{name}"), F.expr(f"row_number() OVER (PARTITION BY {', '.join(by)} ORDER BY {', '.join(order)})").alias("_p"))
    both = number(legacy, "a").join(number(modern, "b"), [*by, "_p"], "full_outer")
    return both.agg(F.count_if(F.col("in_a").isNull() | F.col("in_b").isNull()).alias("unmatched"), F.count_if(F.abs(F.col("a") - F.col("b")) > tolerance).alias("different"), F.count("*").alias("positions"))


def shadow_statistics(results: DataFrame, delta: Column, tolerance: float) -> DataFrame:
    """Number of results, equivalent ones and the mean difference."""
    return results.agg(F.count("*").alias("n"), F.count_if(delta <= tolerance).alias("equivalent"), F.avg(delta).alias("mean_delta"))


def expired(results: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Results older than the retention, for deletion; the others stay."""
    return results.where(F.col(ts) < as_of - F.expr(f"INTERVAL {days} DAYS"))


def match_rates(joined: DataFrame, keys: Sequence[str], fields: dict[str, Column], least: float = 1.0) -> DataFrame:
    """(keys, match_rate) of replays whose share of matching fields is under ``least``; a null comparison is no match."""
    hits = [F.coalesce(c, F.lit(False)).cast("int") for c in fields.values()]
    return joined.select(*keys, (sum(hits[1:], hits[0]) / len(hits)).alias("match_rate")).where(F.col("match_rate") < least)
