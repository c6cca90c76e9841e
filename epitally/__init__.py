"""Surveillance analytics on Spark: DataFrame operators and the reports built from them."""
