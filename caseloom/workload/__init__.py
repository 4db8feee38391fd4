"""The operators over the given tables, each with its check in plain SQL where SQL can say it."""
