"""Training-data operators: one module each, and the registered queries in ``plans``."""
