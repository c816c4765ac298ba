"""Column to Column functions: codes, times and labels."""
