"""A PySpark-native engine for searching, chunking and evaluating collections of source files and documents."""
