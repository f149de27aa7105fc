"""loamgrid.plans"""
