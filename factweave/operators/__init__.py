"""factweave.operators"""
