"""Parallel-corpus preparation, augmentation and evaluation on Spark DataFrames."""
