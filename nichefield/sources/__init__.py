"""Reading occurrence points and writing surfaces and tables."""

from .points import read_geojson_points, read_points
from .tables import read_surface, write_surface, write_table

__all__ = ["read_points", "read_geojson_points", "read_surface", "write_surface", "write_table"]
