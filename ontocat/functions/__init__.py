"""Column-level functions: scalars (IRIs, names, literals) and trigram sets."""
