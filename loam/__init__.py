"""loam: a Spark-native engine that turns raw web pages into a searchable, curated corpus."""
