"""loamgrid.streaming"""
