"""Bibliometric analytics as lazy DataFrame operators on Spark SQL."""
