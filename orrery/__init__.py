"""orrery: DataFrame-native analytics over replicate-scored ranking tables."""

__version__ = "0.1.0"
