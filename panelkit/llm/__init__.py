"""Text operators for building training corpora (see ``catalog`` for the registered queries)."""
