"""Value profiling, resolution, masking, gating and evaluation on Spark, and operators for building training corpora."""
