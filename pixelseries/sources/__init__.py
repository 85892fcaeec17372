"""Scans: catalog, cubes, lists, rings. Sinks: partitioned tables, ledgers, exports."""
