"""Scans, sinks and TESTDATA-derived panels."""
