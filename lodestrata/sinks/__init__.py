"""What leaves the engine: logs as CSV, stores as JSON, reports as text."""
