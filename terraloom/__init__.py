"""Terraloom: map and delivery-logistics dataset jobs on PySpark."""
