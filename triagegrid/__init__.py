"""Ticket triage and its evaluation as Spark DataFrame operators."""
