"""evalcat: evaluation-run and model-catalog analytics on Spark DataFrames.

Sub-packages:
  sources    file scans and sinks (examples, results, runs, inventories)
  functions  Column -> Column scalar functions (scoring, text, catalog rules)
  operators  DataFrame -> DataFrame operators (joins, aggregates, windows)
  plans      adapter views over the shared test tables and the registered queries
  streaming  Structured Streaming jobs (progress, upsert sink, run state)
"""

__version__ = "0.1.0"
