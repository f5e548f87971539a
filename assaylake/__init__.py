"""Assaylake: evidence-grade analytics on Spark DataFrames.

Subpackages
-----------
``sources``    readers for site files, round files, rules and corpora
``functions``  column expressions and Arrow UDFs
``operators``  DataFrame-to-DataFrame operators
``plans``      named queries with their DuckDB counterparts
``streaming``  stateful stream operators
``llm``        training-data operators (optional; nothing else imports it)
"""

__version__ = "0.1.0"
