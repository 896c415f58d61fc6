"""weekcraft.sources"""
