"""inkframe.operators"""
