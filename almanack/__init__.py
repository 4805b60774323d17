"""Annual indicator reporting on published statistical panels, written for Spark.

Sub-packages
------------
functions   Column expressions: casts, null rules, rates, labels.
sources     Delimited files, tables, lookups, HTML cells; chart-row and table sinks.
operators   DataFrame -> DataFrame building blocks: filters, joins, sums, reshapes, orders.
plans       One function per published indicator, and the report job built from them.
"""
