"""weekcraft.plans"""
