"""cloakspark.streaming"""
