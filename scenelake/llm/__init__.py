"""Operators of a training-data pipeline: filters, near-duplicates, language, toxicity, mixing and sharding.

Nothing outside this package imports it; its queries are in ``scenelake.llm.queries``.
"""

import pyspark.cloudpickle as _cloudpickle

import scenelake as _scenelake

# Workers may start in another folder: send the functions themselves.
_cloudpickle.register_pickle_by_value(_scenelake)
