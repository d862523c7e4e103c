"""Readers and writers for photo folders, rasters and reports."""
