"""tidemark: learning-analytics and corpus preparation as Spark jobs."""
