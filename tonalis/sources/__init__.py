"""Readers: audio trees, annotations, manifests, score tables. All listings and parses are distributed."""
