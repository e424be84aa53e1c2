"""inkframe.plans"""
