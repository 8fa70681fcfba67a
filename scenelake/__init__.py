"""Spark-native Earth-observation catalogue, retrieval and change analytics.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing here collects data to the driver.
"""
