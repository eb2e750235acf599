"""A Spark-native engine for spaceborne-lidar footprints."""
