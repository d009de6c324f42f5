"""Packet-sequence anomaly analytics written as Spark DataFrame operators."""
