"""Imports every family of registered queries."""

from workload import q_feed  # noqa: F401
from workload import q_functions  # noqa: F401
from workload import q_insight  # noqa: F401
from workload import q_reports  # noqa: F401
from workload import q_search  # noqa: F401
from workload import q_jobs  # noqa: F401
from workload import q_sources  # noqa: F401
from workload import q_streams  # noqa: F401
