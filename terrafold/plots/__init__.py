"""plots"""
