"""Detection of risky behaviour in large corpora of package build scripts, on Spark DataFrames."""
