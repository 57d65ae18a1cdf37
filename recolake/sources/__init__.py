"""recolake.sources"""
