"""Letterloom: labelled-letter analytics as composable Spark DataFrame transforms."""
