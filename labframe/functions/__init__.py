"""labframe.functions"""
