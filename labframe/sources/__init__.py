"""labframe.sources"""
