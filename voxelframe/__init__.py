"""voxelframe: gridded volumes and surfaces as Spark DataFrames."""

__version__ = "0.1.0"
