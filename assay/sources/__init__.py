"""Sources and sinks: file inventory, verdict log, snapshots, portable records, reports."""
