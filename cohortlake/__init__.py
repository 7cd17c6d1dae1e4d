"""Claims cohorts, features, outcomes and risk-model evaluation on Spark DataFrames."""
