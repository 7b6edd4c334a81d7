"""End-to-end plans: the graph build, reports, and the query catalogue."""
