"""pagelake: collections of structured paged documents as Spark tables."""
