"""Catalogs as literal tables. A folder of rule files, read by sources.files, can take their place."""
