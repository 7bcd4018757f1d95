"""Social posts and price series as analysis-ready Spark tables."""
