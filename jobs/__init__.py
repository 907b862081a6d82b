"""Runnable jobs: each takes a session and a small config, reads and writes with Spark, and reruns with the same result."""
