"""quillwork.streaming"""
