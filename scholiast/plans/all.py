"""Importing this module registers every query."""

from scholiast.plans import assist, catalogs, graphs, libraries, manuscripts, papers, planner, readers, relational, retrieval, streams, styles, table_functions, texts, venues  # noqa: F401
