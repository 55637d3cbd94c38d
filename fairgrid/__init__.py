"""fairgrid: calendar-event analytics as plain PySpark DataFrame functions."""
