"""rainloom.streaming"""
