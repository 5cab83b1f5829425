"""Runnable jobs: each is a command line, a small configuration file and a function that takes a session."""
