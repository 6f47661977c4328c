"""Time, rectangles and descriptors."""
