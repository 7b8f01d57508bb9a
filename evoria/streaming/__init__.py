"""evoria.streaming"""
