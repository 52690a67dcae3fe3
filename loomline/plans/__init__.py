"""loomline.plans"""
