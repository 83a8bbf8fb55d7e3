"""Sources and sinks: tables, the dataset store and the workbook folder reader."""
