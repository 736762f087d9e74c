"""Mobile-app telemetry analytics on Spark: ingest, tables, rollups, dashboards and alerts."""
