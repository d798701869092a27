"""Types, the expression language and column statistics."""
