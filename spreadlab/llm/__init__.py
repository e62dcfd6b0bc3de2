"""Training-data operators: packing, chat formatting, near-duplicates, fingerprints, token
counts, web archives, sharding, language ID, decontamination, URL lists, fill-in-the-middle,
conversation tries and best-fit packing.

Nothing else in the package imports this one.
"""
