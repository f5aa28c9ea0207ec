"""Conversation-safety analytics as DataFrame-to-DataFrame operators on Spark."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors by value, so that nothing has to
# be installed or shipped there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
