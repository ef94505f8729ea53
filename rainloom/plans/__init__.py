"""rainloom.plans"""
