"""wordloom: a PySpark-native text-embedding data engine.

Text preparation, WordPiece tokenisation against a vocabulary table, length
policies, token accounting, batch assignment, distributed sentence encoding,
vector post-processing, quantisation, parity and latency reports -- all as
DataFrame -> DataFrame functions that Catalyst plans and Spark distributes.
"""

__version__ = "0.1.0"
