"""Line-based parsers of legacy sources (I6, M24): units, data items, calls, with line numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: For each language: (kind, pattern whose first group is the name). The first that matches a line wins.
GRAMMARS = {
    "cobol": [("program", r"(?i)^\s*PROGRAM-ID\.\s*([\w-]+)"), ("section", r"(?i)^\s*([\w-]+)\s+SECTION\s*\."), ("call", r"(?i)\bCALL\s+['\"]([\w-]+)"), ("copy", r"(?i)\bCOPY\s+([\w-]+)"), ("perform", r"(?i)\bPERFORM\s+([\w-]+)"), ("data", r"(?i)^\s*\d\d\s+([\w-]+)"), ("paragraph", r"^\s{0,3}([A-Z0-9][\w-]*)\.\s*$")],
    "fortran": [("program", r"(?i)^\s*PROGRAM\s+(\w+)"), ("subroutine", r"(?i)^\s*SUBROUTINE\s+(\w+)"), ("function", r"(?i)\bFUNCTION\s+(\w+)"), ("call", r"(?i)\bCALL\s+(\w+)"), ("data", r"(?i)^\s*(?:INTEGER|REAL|DOUBLE PRECISION|LOGICAL|CHARACTER(?:\*\d+)?)\s+(\w+)")],
    "vb6": [("function", r"(?i)^\s*(?:Public |Private )?Function\s+(\w+)"), ("sub", r"(?i)^\s*(?:Public |Private )?Sub\s+(\w+)"), ("call", r"(?i)\bCall\s+(\w+)"), ("data", r"(?i)^\s*Dim\s+(\w+)")],
    "java": [("class", r"\bclass\s+(\w+)"), ("method", r"^\s*(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\]]+\s+(\w+)\s*\("), ("import", r"^\s*import\s+([\w.]+)")],
    "rpg": [("file", r"(?i)^\s*F(\w{1,10})\s"), ("procedure", r"(?i)\bDCL-PROC\s+(\w+)"), ("data", r"(?i)\bDCL-S\s+(\w+)"), ("call", r"(?i)\bCALLP?\s+['\"]?(\w+)")],
    "pli": [("procedure", r"(?i)^\s*(\w+)\s*:\s*PROC"), ("call", r"(?i)\bCALL\s+(\w+)"), ("data", r"(?i)\bDCL\s+(\w+)")],
    "natural": [("subroutine", r"(?i)\bDEFINE\s+SUBROUTINE\s+([\w-]+)"), ("call", r"(?i)\bCALLNAT\s+['\"]([\w-]+)"), ("perform", r"(?i)\bPERFORM\s+([\w-]+)"), ("data", r"^\s*\d\s+#?([\w-]+)\s*\(")],
    "hlasm": [("section", r"^(\w+)\s+CSECT"), ("macro", r"^\s+MACRO\s+(\w+)"), ("call", r"\bCALL\s+(\w+)"), ("data", r"^(\w+)\s+D[SC]\s")],
    "cics": [("command", r"(?i)\bEXEC\s+CICS\s+(\w+)"), ("program", r"(?i)\bPROGRAM\s*\(\s*['\"]?([\w-]+)"), ("file", r"(?i)\b(?:FILE|DATASET)\s*\(\s*['\"]?([\w-]+)")],
}


def parse_units(lines: DataFrame, language: str) -> DataFrame:
    """(…, kind, name) of lines that declare or use a unit; lines that match nothing are left out."""
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, pattern in reversed(GRAMMARS[language]):
        hit = F.col("line").rlike(pattern)
        kind, name = F.when(hit, F.lit(k)).otherwise(kind), F.when(hit, F.regexp_extract("line", pattern, 1)).otherwise(name)
    return lines.withColumns({"kind": kind, "name": name}).where("kind IS NOT NULL")


def jcl_steps(lines: DataFrame, key: str = "file", order: str = "line_no") -> DataFrame:
    """Each EXEC step with its program and the nearest job card before it."""
    job, step = F.regexp_extract("line", r"^//(\w+)\s+JOB\b", 1), F.regexp_extract("line", r"^//(\w+)\s+EXEC\b", 1)
    program = F.regexp_extract("line", r"\bPGM=(\w+)", 1)
    marked = lines.select(key, order, F.nullif(job, F.lit("")).alias("_job"), F.nullif(step, F.lit("")).alias("step"), program.alias("program"))
    filled = marked.withColumn("job", F.expr(f"last(_job, true) OVER (PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"))
    return filled.where("step IS NOT NULL").select(key, order, "job", "step", "program")


def sequential_reads(records: DataFrame, key: str, order: str) -> DataFrame:
    """Records in order with file status 00, and a last row with status 10 (end of file)."""
    numbered = records.select(key, F.expr(f"row_number() OVER (PARTITION BY {key} ORDER BY {order})").alias("read_no"), F.lit("00").alias("status"))
    ends = records.groupBy(key).agg((F.count("*") + 1).cast("int").alias("read_no")).withColumn("status", F.lit("10"))
    return numbered.unionByName(ends)


def file_program(steps: DataFrame, records: DataFrame) -> DataFrame:
    """steps(step, file, operation, data) with the status and data of each: 00, 10 at the end of a file, 42 where it is not open.

    ``records(file, record_no, data)`` are what files hold at first. OPEN
    starts reading anew, OPEN-OUTPUT empties the file, WRITE appends, CLOSE
    closes; any other operation reads.

    Running windows over a file's steps say whether it is open, which content
    it has (emptying begins a new one), how long that is and how far reading
    has come: of the reads since the last OPEN, the j-th has reached the least
    of j and, for each read i up to it, the length then plus j - i. What a read
    gets is a join by content and place, so no task holds a file.
    """
    w, before = "PARTITION BY file ORDER BY step", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    opens = F.col("operation").startswith("OPEN")
    state = steps.withColumn("_opens", opens).withColumns({
        "_open": F.expr(f"coalesce(last(CASE WHEN operation LIKE 'OPEN%' THEN true WHEN operation = 'CLOSE' THEN false END, true) OVER ({w} {before}), false)"),
        "_content": F.expr(f"count_if(operation = 'OPEN-OUTPUT') OVER ({w})"),
        "_session": F.expr(f"count_if(_opens) OVER ({w})"),
    })
    active = F.col("_open") & ~F.col("_opens")
    state = state.withColumns({"_writes": active & (F.col("operation") == "WRITE"), "_reads": active & ~F.col("operation").isin("CLOSE", "WRITE")})
    held = records.groupBy("file").agg(F.count("*").alias("_held"))
    state = state.join(held, "file", "left").withColumn("_first", F.when(F.col("_content") == 0, F.coalesce("_held", F.lit(0))).otherwise(0))
    of = "PARTITION BY file, _session ORDER BY step"
    state = state.withColumn("_length", F.col("_first") + F.expr("count_if(_writes) OVER (PARTITION BY file, _content ORDER BY step)")).withColumn("_j", F.expr(f"count_if(_reads) OVER ({of})"))
    state = state.withColumn("_at", F.least("_j", F.col("_j") + F.expr(f"min(CASE WHEN _reads THEN _length - _j END) OVER ({of})")))
    state = state.withColumn("_got", F.col("_reads") & (F.col("_at") > F.expr(f"coalesce(max(CASE WHEN _reads THEN _at END) OVER ({of} {before}), 0)")))
    first = records.select("file", F.lit(0).cast("long").alias("_content"), F.expr("row_number() OVER (PARTITION BY file ORDER BY record_no)").cast("long").alias("_at"), F.col("data").alias("_read"))
    content = first.unionByName(state.where("_writes").select("file", "_content", F.col("_length").alias("_at"), F.col("data").alias("_read")))
    status = F.when(~F.col("_open") & ~F.col("_opens"), "42").when(F.col("_reads") & ~F.col("_got"), "10").otherwise("00")
    return state.join(content, ["file", "_content", "_at"], "left").select("step", "file", "operation", status.alias("status"), F.when(F.col("_got"), F.col("_read")).alias("data"))
