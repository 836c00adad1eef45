"""Corpus operators for training-data pipelines.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` binds them to the tables the checker registers.
"""
