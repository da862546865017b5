"""Table preparation, reconciliation and synchronisation on Spark DataFrames."""
