"""loomline.functions"""
