"""Whole modelling runs composed from the operators."""
