"""Runnable jobs over the library; each takes plain paths and a small config file."""
