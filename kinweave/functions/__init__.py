"""kinweave.functions"""
