"""Parsing of fetched bodies held in tables: feeds, sitemaps, listings, pages, robots, APIs."""
