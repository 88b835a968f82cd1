"""Fault-log analytics as Spark DataFrame operators."""
