"""Set-based operators over records, values, events and span trees."""
