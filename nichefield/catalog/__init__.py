"""Every operator as a named query over the given tables, with a SQL twin where one exists."""

from . import modelling, points, surfaces

QUERIES = {**points.QUERIES, **modelling.QUERIES, **surfaces.QUERIES}
ORACLES = {**points.ORACLES, **modelling.ORACLES, **surfaces.ORACLES}
