"""Trend research on bars of price series: sources, indicators, signals, simulation, sweeps and statistics on Spark."""
