"""recolake.operators"""
