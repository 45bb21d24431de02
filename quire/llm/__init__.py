"""Operators for training data, each as a Spark job over whole tables; nothing else in the library imports them."""
