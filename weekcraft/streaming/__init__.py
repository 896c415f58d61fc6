"""weekcraft.streaming"""
