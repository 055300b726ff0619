"""Data preparation, modelling and evaluation operators as Spark programs."""
