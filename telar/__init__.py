"""telar: Spark jobs for large collections of tender documents."""
