"""labframe.plans"""
