"""Offer response, incrementality and targeting on Spark DataFrames."""

from offertide.settings import Settings

__all__ = ["Settings"]
