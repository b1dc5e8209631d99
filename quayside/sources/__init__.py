"""Sources: delimited files, text lines, JSON documents, dated scans, object listings."""
