"""stemma: a PySpark-native engine for keyed passages, entities and the links between them."""
