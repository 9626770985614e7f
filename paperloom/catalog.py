"""Every query of the engine by name, with its SQL oracle."""

from paperloom.plans import export_queries, layout_queries, mapping_queries, record_queries, store_queries, table_queries, template_queries, text_queries, zonal_queries

_MODULES = (text_queries, mapping_queries, table_queries, zonal_queries, record_queries, store_queries, template_queries, export_queries, layout_queries)
QUERIES = {name: call for module in _MODULES for name, call in module.CATALOG.queries.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.CATALOG.oracles.items()}
