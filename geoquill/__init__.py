"""geoquill: point-candidate labelling, spatial joins, splits and evaluation as lazy Spark DataFrame transforms."""
