"""Column functions: Column(s) in, Column out, all evaluated inside the JVM."""
