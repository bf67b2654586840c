"""Training-data operators: thirteen operators and their queries.

Nothing else in the package imports this subpackage.  ``queries.QUERIES`` and
``queries.ORACLES`` hold the registered queries and their SQL.
"""
