"""All queries by name, with the SQL each must agree with. Importing the plan modules fills the tables."""

from __future__ import annotations

from lintlake.plans import finding_plans, graph_plans, io_plans, program_plans, report_plans, rule_plans, scoring_plans, source_plans, triage_plans  # noqa: F401
from lintlake.plans.base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "a10_score_by_family_mode"
