"""tidemark: counterfactual analytics on Spark DataFrames."""

import os
import sys

from pyspark import cloudpickle

# Tasks fill the cores: each has one BLAS thread. A cluster sets spark.executorEnv.OMP_NUM_THREADS=1; local workers inherit this.
os.environ.setdefault("OMP_NUM_THREADS", "1")
# Kernels travel to the executors by value, so that a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
