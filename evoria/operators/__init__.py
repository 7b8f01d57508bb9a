"""evoria.operators"""
