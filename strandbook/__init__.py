"""strandbook: versioned event streams as Spark tables."""
