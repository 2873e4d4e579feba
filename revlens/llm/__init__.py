"""Training-data operators: packing, dedup, mixing, fingerprints, scoring.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its
queries when the package is present.
"""
