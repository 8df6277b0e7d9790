"""Writers for lines, batches of lines and alert events."""
