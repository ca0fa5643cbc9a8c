"""Cohort audits, per-entity trends and validated clustering as Spark jobs."""
