"""weekcraft.operators"""
