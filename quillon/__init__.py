"""Vector analytics, statistical learning and text-corpus operators on Spark DataFrames."""
