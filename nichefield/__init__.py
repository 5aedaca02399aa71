"""nichefield: habitat-suitability modelling expressed as Spark DataFrame operators."""

from .grid import Grid, Layer

__all__ = ["Grid", "Layer"]
