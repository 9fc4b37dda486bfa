"""palisade: a Spark-native engine that moderates short messages and prepares training text."""
