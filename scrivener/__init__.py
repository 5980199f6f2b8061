"""Text retrieval, cleaning and corpus building on Spark."""
