"""Column expressions shared by the operators; all evaluated inside the JVM."""
