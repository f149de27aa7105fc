"""loamgrid.sources"""
