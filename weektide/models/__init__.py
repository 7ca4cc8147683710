"""Spark ML jobs on the weekly panel."""
