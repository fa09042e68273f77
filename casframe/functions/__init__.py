"""Scalar functions: hashing, codecs, sniffing, text and access rules."""
