"""Reading stored pages and state tables, writing snapshots."""
