"""Scans of landed payloads (JSON, HTML, mail) and sinks for notifications. Fetching is outside: files are landed first."""
