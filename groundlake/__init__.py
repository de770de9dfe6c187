"""groundlake: document question answering data work as Spark jobs."""
