"""labframe.operators"""
