"""corvane: a PySpark-native engine for code-intelligence, graph, text and event analytics."""
