"""Corpus preparation operators for language-model training data, each a Spark job."""
