"""Analytics over ordered, gap-aware event and frame tables, written as Spark DataFrame functions."""
