"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` holds the registered queries and their SQL.
"""
