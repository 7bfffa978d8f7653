"""Column-expression builders: similarities, keys, text, units and dates. All run on the JVM."""
