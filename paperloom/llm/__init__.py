"""Training-data operators: one module per operator, and ``entries`` with their queries.

Nothing else in the library imports this subpackage.
"""
