"""Column-level functions (no UDFs): text shaping, normalisation, encoders."""
