"""Ranked growth recommendations from a (location, product, year) panel, on Spark."""

from growthlens.config import DECADES, PAIR, PeriodSpec, Splits

__all__ = ["DECADES", "PAIR", "PeriodSpec", "Splits"]
