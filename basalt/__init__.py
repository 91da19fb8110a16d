"""Listing intelligence and corpus preparation as Spark DataFrame jobs."""
