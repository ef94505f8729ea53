"""rainloom.operators"""
