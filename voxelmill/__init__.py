"""Voxel analytics and training-data preparation as ordinary Spark jobs."""
