"""orgweave: a PySpark-native engine for scoring organisation identifiers on affiliation text."""
