"""weekcraft.functions"""
