"""The three entry points as plans over tables."""
