"""Dataset workflows for language-model data on Spark DataFrames."""
