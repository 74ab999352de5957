"""Document-layout analytics on Spark: scans, geometry, filters, tasks, serialisation, mixing, metrics, audits and telemetry."""
