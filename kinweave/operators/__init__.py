"""kinweave.operators"""
