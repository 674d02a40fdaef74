"""Operators for preparing language-model training data, each as a Spark job."""
