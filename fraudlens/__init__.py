"""fraudlens: Spark-native bank-transaction fraud analytics.

Every public function maps DataFrame -> DataFrame (or a small fitted artefact)
so that Catalyst plans the work and it scales with the cluster.
"""

__version__ = "0.1.0"
