"""Readers and writers of the text and binary formats of clouds, trajectories, meshes and maps."""
