"""Sources and sinks: tables, chunk folders, local trees."""
