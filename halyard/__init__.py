"""Resolving status from semi-structured text with Spark: columns in, columns out."""
