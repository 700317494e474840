"""Frame analytics on Spark: quality, motion, trajectory and keyframe operators."""
