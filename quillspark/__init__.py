"""quillspark: document analytics and hybrid retrieval as Spark DataFrame jobs."""
