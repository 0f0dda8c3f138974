"""Sources and sinks: landed filing files, fixed-schema parsing, test adapters."""
