"""Document, review, audit and grade lakehouse metadata as Spark jobs."""
