"""Part of the library: functions."""
