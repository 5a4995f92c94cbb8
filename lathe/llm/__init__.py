"""Training-data operators: ten corpus operations, their queries and SQL.

Nothing else in the package imports this subpackage.
"""
