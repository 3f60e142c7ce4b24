"""threadloom: a PySpark-native engine for paired-sequence alignment analytics."""
