"""Query plans over the driver tables, each beside its SQL oracle."""
