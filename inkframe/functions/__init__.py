"""inkframe.functions"""
