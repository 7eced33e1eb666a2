"""Skill-market analytics on Spark: DataFrame-to-DataFrame operators and their query catalogue."""
