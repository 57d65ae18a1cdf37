"""recolake.sinks"""
