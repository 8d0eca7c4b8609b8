"""Sources and sinks: CSV intake, table access, driver-table adapter, writers."""
