"""Graph, ranking, archive, statistics and log operators."""
