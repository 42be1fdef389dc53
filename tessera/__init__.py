"""tessera: a PySpark engine that turns noisy text collections into ranked, de-duplicated evidence."""
