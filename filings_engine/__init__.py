"""filings_engine: company-filing analytics as lazy Spark DataFrame plans.

Every public function takes DataFrames (and plain parameters) and returns
DataFrames.  Nothing collects to the driver; no function keeps a global
session.
"""

from filings_engine.session import build_session, checkpoint_dir, materialize, spread

__all__ = ["build_session", "checkpoint_dir", "materialize", "spread"]
