"""Spark-native analytics for building, running and judging image-segmentation datasets."""
