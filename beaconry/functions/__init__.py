"""Column expressions over signals, coordinates and vectors; all of them stay inside the JVM."""
