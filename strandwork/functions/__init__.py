"""Column expressions; nothing in here triggers a job."""
