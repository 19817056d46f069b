"""factweave.functions"""
