"""recolake.plans"""
