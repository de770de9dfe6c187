"""groundlake.operators"""
