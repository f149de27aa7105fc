"""loamgrid.operators"""
