"""The operators of a query object, each with its parser and its Spark form."""
