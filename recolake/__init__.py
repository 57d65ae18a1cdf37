"""recolake: recommendation and product analytics as Spark jobs.

Entry points: ``recolake.session.build_session`` / ``prepare``, the canonical
tables in ``recolake.sources.tables``, DataFrame-in/DataFrame-out operators in
``recolake.operators``, Structured Streaming jobs in ``recolake.streaming``,
the query catalog in ``recolake.plans.catalog.load_all`` and the end-to-end
jobs in ``recolake.plans.jobs``.
"""
