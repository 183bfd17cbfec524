"""kinweave.sources"""
