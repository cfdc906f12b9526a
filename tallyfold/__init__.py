"""Document analytics on PySpark: cells, sections, retrieval, statistics, voting, grading."""
