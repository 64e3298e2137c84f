"""Registered queries over the driver's test tables (proxies for assay data)."""
