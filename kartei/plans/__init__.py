"""How the work is spread: chunked groups, hot keys, numbering and shared storage."""
