"""apflow: accounts-payable analytics as Spark DataFrame jobs.

Every public function takes DataFrames (and plain literals) and returns a
DataFrame. Nothing is collected to the driver; Catalyst and adaptive query
execution choose join strategies from runtime sizes.
"""

from apflow.session import get_session

__all__ = ["get_session"]
