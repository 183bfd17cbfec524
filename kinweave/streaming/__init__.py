"""kinweave.streaming"""
