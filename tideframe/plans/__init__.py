"""Strategy documents: checking, rewriting, identity, and compilation to columns."""
