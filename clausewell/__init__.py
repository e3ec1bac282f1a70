"""Evidence retrieval, fact lookup and corpus preparation as Spark jobs."""
