"""See the package docstring; one module per family of operators."""
