"""Lexbolt: document-corpus analytics on PySpark DataFrames."""
