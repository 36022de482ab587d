"""Training-data pipeline operators; self-contained, imported by nothing else in the library."""
