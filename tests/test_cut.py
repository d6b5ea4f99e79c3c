"""What a cut leaves on disk."""

import time

from pyspark.sql import functions as F

from tessera.operators import compare, graph
from tessera.operators.components import checkpointed, release


def shuffle_files(spark):
    """Names of the shuffle files on disk; they are removed in the background."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle")}


def left_of(spark, before):
    until = time.time() + 10
    while time.time() < until and shuffle_files(spark) - before:
        time.sleep(0.2)
    return shuffle_files(spark) - before


def stored_files(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getFileCount()


def test_a_cut_computes_rows_once_and_removes_its_shuffles(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        calls.add(1)
        return x

    before = shuffle_files(spark)
    rows = spark.range(100).repartition(4, "id").select(counted("id").alias("id"))
    kept = checkpointed(rows)
    assert calls.value == 100 and not left_of(spark, before)
    assert kept.count() == 100 and sorted(r["id"] for r in kept.collect()) == list(range(100)) and calls.value == 100
    # The frame itself can still be read.
    assert rows.count() == 100 and checkpointed(rows.limit(0)).collect() == []


def test_release(spark):
    kept, other = checkpointed(spark.range(10)), spark.range(3)
    n = stored_files(spark)
    release(kept, other)
    assert stored_files(spark) < n and other.count() == 3


def test_label_propagation_shuffles_its_steps_once(spark, monkeypatch):
    monkeypatch.setattr(graph, "STEPS_OF_TASK", 500)
    edges = spark.createDataFrame([(f"a{k}", f"b{k % 50}") for k in range(2000)], "source string, target string")
    steps = graph.sorted_steps(graph.undirected(graph.numbered(edges)[0]), "target")
    labels = checkpointed(steps.select(F.col("source").alias("number")).distinct())
    plan = steps.join(labels.hint("merge"), F.col("target") == F.col("number"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(target" not in plan, plan


def test_fragments_meet_without_a_row_for_each_shared_word(spark):
    rows = lambda texts: spark.createDataFrame([("k", i, t) for i, t in enumerate(texts)], "key string, start_line int, content string")
    met = compare.fragment_scores(rows(["Red fox, red hen", "an ox", None]), rows(["hen fox owl cat", "", "red; RED"]), "key")
    assert {tuple(r) for r in met.collect()} == {("k", 0, 0, 0.5), ("k", 0, 2, 1 / 3)}
    assert "Aggregate" not in met._jdf.queryExecution().executedPlan().toString()
