"""Sources: files, versioned tables, the run log."""
