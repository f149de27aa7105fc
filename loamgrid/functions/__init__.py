"""loamgrid.functions"""
