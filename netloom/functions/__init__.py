"""netloom.functions"""
