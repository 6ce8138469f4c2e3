"""cloakspark.sources"""
