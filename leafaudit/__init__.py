"""leafaudit: page-corpus quality and pipeline-state analytics on Spark DataFrames."""
