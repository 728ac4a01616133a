"""Column expressions: lenient casts, labels and small algebra. Missing is NULL, never NaN."""
