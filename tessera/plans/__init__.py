"""The star-schema queries q01 to q22."""
