"""Reading and writing: CSV, dated drops, run directories, model tables, calibration files."""
