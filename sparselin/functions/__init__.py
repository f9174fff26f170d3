"""Column expressions: parsing, per-row algebra, losses, run tags, relative gaps."""
