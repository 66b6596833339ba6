"""A PySpark-native engine for spatial and sensor data: clouds, Gaussian cells, evidence, poses, particles, volumes, meshes."""
