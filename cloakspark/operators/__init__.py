"""cloakspark.operators"""
