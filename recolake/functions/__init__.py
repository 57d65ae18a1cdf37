"""recolake.functions"""
