"""Curating labelled datasets and evaluating classifiers on Spark."""
