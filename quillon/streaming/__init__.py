"""Micro-batches over keyed state."""
