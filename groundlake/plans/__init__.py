"""groundlake.plans"""
