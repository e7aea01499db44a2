"""Operators over corpora, questions and stores; each takes and returns DataFrames."""
