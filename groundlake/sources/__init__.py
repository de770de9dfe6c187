"""groundlake.sources"""
