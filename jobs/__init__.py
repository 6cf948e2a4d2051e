"""Runnable jobs: each has a command line, a small config file and a function that takes a session."""
