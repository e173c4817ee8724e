"""Table scans and record sources."""
