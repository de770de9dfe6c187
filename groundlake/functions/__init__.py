"""groundlake.functions"""
