"""flankwear: Spark-native tool-wear analytics.

Raw multi-channel sensor passes are reduced to per-pass statistical and
spectral features, labeled with wear measurements, profiled, fused with other
experiment sources, split into cross-validation folds, fed to ``pyspark.ml``
models and summarised as metric / report tables -- all as DataFrame plans.
"""

__version__ = "0.1.0"
