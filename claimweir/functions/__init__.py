"""Column-level building blocks: text, money, identifiers."""
