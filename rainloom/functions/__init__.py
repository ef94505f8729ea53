"""rainloom.functions"""
