"""inkframe.streaming"""
