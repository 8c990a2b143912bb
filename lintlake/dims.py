"""Small dimension tables and the expressions over them: one rank table for all orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities, triage states and vulnerability types of the findings model.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "UNKNOWN")
STATUSES = ("confirmed", "likely", "needs-review", "suppressed")
MODES = ("all", "visible", "high-confidence")


def case(col: Column, table: dict, default=None) -> Column:
    """CASE col WHEN key THEN value ... ELSE default."""
    out = None
    for k, v in table.items():
        out = F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


def queue_rank(severity: Column) -> Column:
    """0 for the most severe; what is unknown last."""
    return case(severity, {s: i for i, s in enumerate(SEVERITIES)}, 5)


def strength(severity: Column) -> Column:
    """The opposite direction: 5 for the most severe."""
    return F.lit(5) - queue_rank(severity)


def status_rank(status: Column) -> Column:
    return case(status, {s: i for i, s in enumerate(STATUSES)}, 4)


def sql_case(col: str, table: dict, default=None) -> str:
    """The same CASE for a SQL oracle."""
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {col} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {lit(default)} END"


QUEUE_RANK_SQL = "CASE {} WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 ELSE 5 END"
STATUS_RANK_SQL = "CASE {} WHEN 'confirmed' THEN 0 WHEN 'likely' THEN 1 WHEN 'needs-review' THEN 2 WHEN 'suppressed' THEN 3 ELSE 4 END"
