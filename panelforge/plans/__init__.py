"""Registered queries: importing this package fills ``registry``."""

from . import q_matrix, q_panel, q_report, q_results, q_risk, q_rolling, q_walk  # noqa: F401
