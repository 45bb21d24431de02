"""quire: structuring of document corpora as Spark DataFrame jobs."""
