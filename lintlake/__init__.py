"""A Spark-first engine for code-scan findings: matching, triage, reports and scoring as DataFrame operators."""
