"""Spark jobs that build, retrieve and grade evidence for help-page answers."""
