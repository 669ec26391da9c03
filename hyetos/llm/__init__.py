"""Training-data operators on text tables: one module per operator.

Nothing else in the library imports this subpackage.
"""
