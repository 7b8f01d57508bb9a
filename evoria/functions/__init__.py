"""evoria.functions"""
