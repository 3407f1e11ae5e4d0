"""DataFrame operators: ``(DataFrame, ...) -> DataFrame`` with explicit ids."""
