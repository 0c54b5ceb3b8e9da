"""Column builders: each takes Columns (and constants) and returns a Column, all JVM-side."""
