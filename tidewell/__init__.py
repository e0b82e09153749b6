"""Spark jobs for event records of participants: reduction, cohorts, features, gap filling, splits, evaluation."""
