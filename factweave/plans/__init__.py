"""factweave.plans"""
