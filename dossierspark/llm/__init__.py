"""Training-data operators: ten corpus operators, each a Spark job with its own module.

Nothing else in the library imports this subpackage.
"""
