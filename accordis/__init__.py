"""Accordis: reconciliation, quality and corpus analytics on PySpark DataFrames."""
