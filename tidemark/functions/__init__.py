"""Column builders that stay on the JVM side."""
