"""Operators of a training-data pipeline over the tables documents and embeddings. Nothing else in the library imports this."""
