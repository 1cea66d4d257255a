"""Readers and writers: CSV, JSON and raster tables, discovery of files, resumed outputs."""
