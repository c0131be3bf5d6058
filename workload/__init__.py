"""The driver's queries: stand-in tables, query functions and check SQL."""
