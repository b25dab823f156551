"""labframe.streaming"""
