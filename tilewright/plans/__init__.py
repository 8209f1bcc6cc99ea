"""End-to-end plans, the stand-in domain tables and the query catalogue."""
