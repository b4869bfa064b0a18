"""Tests and models: Spark reduces the data, the driver solves p by p systems."""
