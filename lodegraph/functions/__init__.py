"""Column functions that stay in the JVM, and record functions for Python workers."""
