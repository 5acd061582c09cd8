"""Spreadsheet lineage and tabular analytics as Spark DataFrame algebra."""
