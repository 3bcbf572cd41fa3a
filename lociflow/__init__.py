"""lociflow: a Spark-native engine for individual x variant data and association summary tables."""

import os

# Tasks are the parallelism: a BLAS that starts threads in each of them, or beside them on the driver, slows all.
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
