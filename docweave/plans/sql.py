"""Read-only SQL over registered views: one statement, checked by its words and
by its parsed plan, with a clamped limit."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# What a statement may start with, and words and functions that it must not have
PREFIXES = ("select", "with", "show", "describe", "desc", "explain")
FORBIDDEN = """insert update delete drop alter create replace truncate grant revoke merge copy call execute comment
lock set reset begin commit rollback vacuum analyze refresh into""".split()
FORBIDDEN_FUNCTIONS = """nextval setval pg_advisory_lock pg_advisory_xact_lock pg_notify pg_read_file pg_read_binary_file
pg_ls_dir pg_stat_file lo_import lo_export dblink dblink_exec""".split()
#: functions of this engine through which a query could call code or read files
ENGINE_FUNCTIONS = ("java_method", "reflect", "try_reflect", "input_file_name", "read_files")


def bare(statement: str) -> str:
    """The statement without comments and without what stands in quotes."""
    out = re.sub(r"/\*.*?\*/", " ", statement, flags=re.S)
    out = re.sub(r"'(?:[^']|'')*'", "''", out)
    out = re.sub(r"--[^\n]*", " ", out)
    return re.sub(r'"(?:[^"]|"")*"', '""', out).strip()


def validate(statement: str) -> str:
    """The statement without a final semicolon, or ValueError."""
    text = bare(statement).rstrip(";").strip().lower()
    if not text:
        raise ValueError("the statement is empty")
    if ";" in text:
        raise ValueError("only one statement is allowed")
    if not text.lstrip("( \t\n").startswith(PREFIXES):
        raise ValueError("only statements that read are allowed")
    words = set(re.findall(r"[a-z_]+", text))
    if found := words & set(FORBIDDEN):
        raise ValueError(f"forbidden: {', '.join(sorted(found))}")
    calls = set(re.findall(r"([a-z_]+)\s*\(", text))
    if found := calls & {*FORBIDDEN_FUNCTIONS, *ENGINE_FUNCTIONS}:
        raise ValueError(f"forbidden functions: {', '.join(sorted(found))}")
    return statement.strip().rstrip(";").strip()


def clamp(limit: int) -> int:
    return max(1, min(int(limit), 1000))


def run_readonly(spark: SparkSession, statement: str, limit: int = 200) -> DataFrame:
    """The rows of a checked statement, at most ``limit`` (1 to 1000) of them
    unless it is one that only describes."""
    text = validate(statement)
    parser = spark._jsparkSession.sessionState().sqlParser()
    plan = parser.parsePlan(text)
    if re.search(r"Insert|Update|Delete|Merge|Create|Drop|Alter|Replace|Truncate", plan.getClass().getSimpleName()):
        raise ValueError("only statements that read are allowed")
    out = spark.sql(text)
    return out if bare(text).lower().startswith(("show", "desc", "explain")) else out.limit(clamp(limit))


def result(df: DataFrame) -> dict:
    """Columns, JSON-safe rows and their number, of a limited result."""
    import json

    rows = [json.loads(r) for r in df.toJSON().collect()]
    return {"columns": df.columns, "rows": rows, "row_count": len(rows)}


def run_within(spark: SparkSession, statement: str, seconds: float = 15.0, limit: int = 200) -> dict:
    """:func:`result` of a checked statement, cancelled after ``seconds``."""
    import threading
    import uuid

    sc, group = spark.sparkContext, f"read-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    sc.setJobGroup(group, "read-only statement", interruptOnCancel=True)
    timer.start()
    try:
        return result(run_readonly(spark, statement, limit))
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"the statement took more than {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.interruptOnCancel", None)


def shown(df: DataFrame, order: list[str], rows: int = 20, chars: int = 4000) -> DataFrame:
    """One row: n_rows, n_columns and the first rows as text, cut to ``chars``."""
    from pyspark.sql import functions as F

    line = F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns))
    first = df.orderBy(*order).limit(rows).select(F.struct(*order).alias("o"), line.alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n")
    cut = F.when(F.length("text") > chars, F.concat(F.left("text", F.lit(chars)), F.lit(f"\n...[truncated: exceeded {chars} chars]"))).otherwise(F.col("text"))
    return first.agg(text.alias("text")).crossJoin(df.agg(F.count("*").alias("n_rows"))).select("n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), cut.alias("text"))
