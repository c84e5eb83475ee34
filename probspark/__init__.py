"""probspark: tractable probabilistic models and their queries over Spark DataFrames."""
