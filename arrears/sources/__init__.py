"""Sources and sinks: driver tables, mapped cases, JSON intake, CSV, the
prediction history table and the model store."""
