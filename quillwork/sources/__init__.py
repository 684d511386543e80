"""quillwork.sources"""
