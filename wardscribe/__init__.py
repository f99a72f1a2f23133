"""Clinical dictation analytics on Spark DataFrames."""
