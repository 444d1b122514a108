"""penmark: authorship and style analysis of large text corpora on Spark."""
