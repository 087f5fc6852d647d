"""Table maintenance as DataFrame merges plus a staged writer."""
