"""Column functions: every one maps columns to a column and runs inside the JVM."""
