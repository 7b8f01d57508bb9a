"""evoria.sources"""
