"""Column expressions; everything here runs inside the JVM."""
