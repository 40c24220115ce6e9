"""Cadastral analytics as Spark jobs: parcels, control points, approvals and survey events."""
