"""Column expressions: geometry of boxes, text predicates and similarities, path classes."""
