"""Column builders.  All of them stay inside the JVM unless the docstring says otherwise."""
