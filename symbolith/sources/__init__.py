"""Sources and sinks: directory scans, captured outputs, registry and cache tables."""
