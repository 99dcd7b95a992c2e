"""DataFrame operators: ordering/splitting, encodings, scoring, metrics, training."""
