"""Column functions: statistics, bytes and formats, headers, containers, text, pixels."""
