"""Registered queries and the SQL that checks them."""

from __future__ import annotations


def modules() -> list:
    from geoloom.plans import checks, objects, points, regions, scenes, terrain

    return [points, terrain, objects, regions, checks, scenes]
