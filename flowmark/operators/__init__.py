"""One module per family of DataFrame operators."""
