"""Training-data operators: thirteen corpus-scale operators and the pipeline built from them.

Nothing else in the library imports this subpackage.
"""
