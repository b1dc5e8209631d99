"""Column expressions: all built from JVM-side functions, none needs Python workers."""
