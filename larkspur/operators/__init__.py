"""Selection, predicates, references, set operations, changes and graphs over record tables."""
