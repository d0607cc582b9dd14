"""gradeloom: a Spark-native engine for evaluating and auditing question-and-answer corpora."""
