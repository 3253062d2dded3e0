"""Column functions (all JVM-side expressions)."""
