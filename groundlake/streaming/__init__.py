"""groundlake.streaming"""
