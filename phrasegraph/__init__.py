"""Text-corpus and labelled-pair-graph analytics as plain PySpark DataFrame jobs."""
