"""factweave.streaming"""
