"""inkframe.sources"""
