"""Runnable jobs: each a function of a session and a configuration, and a command line around it."""
