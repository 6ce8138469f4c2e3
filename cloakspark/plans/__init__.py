"""cloakspark.plans"""
