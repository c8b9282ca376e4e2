"""Tables: specifications, partitions, external files, load methods, backups, change feed."""
