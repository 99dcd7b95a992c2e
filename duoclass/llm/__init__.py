"""Training-data operators: ten corpus jobs run as Spark stages.

Nothing else in the library imports this subpackage.
"""
