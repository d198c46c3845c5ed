"""PySpark-native record profiling, matching, merging and corpus preparation."""
