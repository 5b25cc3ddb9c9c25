"""Training-data operators: thirteen operators over document, vector and conversation tables.

Nothing else in the library imports this subpackage.
"""
