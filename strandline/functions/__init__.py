"""Column functions, each from Columns to a Column."""
