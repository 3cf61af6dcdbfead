"""Operators for building language-model training sets, each a DataFrame job."""
