"""Operators over points, boxes, rasters, tracks, sensors, documents and pictures."""
