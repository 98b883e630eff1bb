"""The query modules, imported for their registrations."""

from tidemark.plans import q_admin, q_codes, q_extra, q_figures, q_more, q_points, q_records, q_rules, q_series, q_signals, q_state, q_trees, q_triggers  # noqa: F401
