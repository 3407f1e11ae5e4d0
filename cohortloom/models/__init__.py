"""Distributed model fits: every pass over the subjects is a Spark job."""
