"""Governed analytics over an event table, expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

from quorumlens.policy import GovernancePolicy, PolicyViolation

__all__ = ["GovernancePolicy", "PolicyViolation"]

# Functions of this package travel to the executors by value, so no executor has to have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
