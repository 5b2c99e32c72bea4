"""ehrflow: longitudinal clinical records as Spark DataFrame operators.

Every operator takes and returns DataFrames (or Columns for the scalar
helpers in :mod:`ehrflow.functions`). Nothing is collected to the driver;
all work is planned by Catalyst and runs on the executors.
"""

from ehrflow.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
