"""quarry: a Spark-first engine for code retrieval, grounded answers and their evaluation."""
