"""Readers of sensor data sets and catalogs, and writers of results. All give or take DataFrames with fixed schemas."""
