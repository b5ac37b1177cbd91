"""Compare and profile versions of tables with Spark."""
