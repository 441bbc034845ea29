"""gradeloom.llm"""
