"""Column functions: they take and return Columns and run inside the JVM."""
