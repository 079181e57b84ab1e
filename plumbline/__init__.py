"""Plumbline: profile, corrupt, check and reconcile sets of related tables on Spark."""
