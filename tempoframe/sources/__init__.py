"""Readers and writers: audio, map files, manifests, caches."""
