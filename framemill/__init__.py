"""framemill: post-processing of detection, mask and pose model output as Spark DataFrame jobs."""
