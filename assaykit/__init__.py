"""A Spark-native quality-control engine for fine-tuning datasets."""
