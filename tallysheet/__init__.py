"""Record reconciliation, linkage and coverage analytics on Spark DataFrames."""
