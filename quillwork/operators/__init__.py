"""quillwork.operators"""
