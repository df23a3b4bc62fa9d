"""Section trees over corpora of paged documents, as Spark jobs."""
