"""botsift: account classification (bot vs human) as Spark DataFrame jobs.

Sub-packages:
  sources    readers, writers and the fixture adapter over the test tables
  functions  scalar column expressions (JVM-side, codegen friendly)
  operators  DataFrame -> DataFrame operators: timeline, features, joins,
             dedupe, spam/text, model, label feedback
  plans      the registered queries and their DuckDB oracle SQL
  streaming  Structured Streaming jobs (label upsert, scoring)
"""

__all__ = ["session", "schemas"]
