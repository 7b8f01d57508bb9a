"""evoria.plans"""
