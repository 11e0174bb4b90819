"""Decoding and encoding of images and sound."""
