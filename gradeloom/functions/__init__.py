"""gradeloom.functions"""
