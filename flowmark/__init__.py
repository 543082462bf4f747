"""Labelled-flow analytics as table-in, table-out Spark operators."""
