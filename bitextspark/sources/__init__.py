"""Readers and writers: text bitext, partitioned corpora, logs, metrics, stages."""
