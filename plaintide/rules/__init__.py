"""Rule tables: the fixed values every scorer works from."""
