"""rainloom.sources"""
