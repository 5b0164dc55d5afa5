"""Only one reading statement may run: the parser decides, not a pattern."""

from __future__ import annotations

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

ROWS = 2000
#: Nodes at the root of plans that write, define or set something.
WRITING = ("Insert", "Create", "Drop", "Alter", "Delete", "Update", "Merge", "Truncate", "Set", "Reset", "Cache", "Uncache", "Refresh", "Load", "Repair", "Add", "Analyze", "Export", "Use", "Call", "Describe", "Show", "Explain", "Clear", "List", "Overwrite", "Append", "Replace")


def refusal(spark: SparkSession, statement: str) -> str | None:
    """Why a statement may not run, or None."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except ParseException as e:
        return f"not one statement that reads: {e.getCondition() or 'it does not parse'}"
    pending = [plan]
    while pending:
        node = pending.pop()
        if node.getClass().getSimpleName().startswith(WRITING) or "Command" in node.getClass().getSimpleName():
            return f"only a query may run, not {node.nodeName()}"
        children = node.children()
        pending += [children.apply(i) for i in range(children.length())]
    return None


def run_read_only(spark: SparkSession, statement: str, rows: int = ROWS) -> tuple[DataFrame, bool]:
    """The first ``rows`` rows of a query, and whether there are more."""
    why = refusal(spark, statement)
    if why:
        raise PermissionError(why)
    probe = spark.sql(statement).limit(rows + 1)
    return probe.limit(rows), probe.count() > rows
