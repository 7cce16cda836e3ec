"""A Spark-native retail lakehouse library: every operator is a function from DataFrame to DataFrame."""
