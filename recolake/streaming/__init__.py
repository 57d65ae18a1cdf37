"""recolake.streaming"""
