"""cloakspark.functions"""
